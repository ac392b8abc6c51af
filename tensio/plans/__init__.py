"""tensio.plans"""
