"""lumen.operators"""
