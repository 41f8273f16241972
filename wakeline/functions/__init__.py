"""wakeline.functions"""
