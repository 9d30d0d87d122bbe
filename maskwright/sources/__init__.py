"""maskwright.sources"""
