"""lumen.streaming"""
