"""tensio.streaming"""
