"""tensio.operators"""
