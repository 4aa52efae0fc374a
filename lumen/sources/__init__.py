"""lumen.sources"""
