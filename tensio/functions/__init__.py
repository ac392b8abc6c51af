"""tensio.functions"""
