"""wakeline.operators"""
