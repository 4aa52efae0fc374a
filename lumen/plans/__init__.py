"""lumen.plans"""
