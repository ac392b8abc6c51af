"""tensio.sources"""
