"""maskwright.operators"""
