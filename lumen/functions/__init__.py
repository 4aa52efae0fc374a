"""lumen.functions"""
