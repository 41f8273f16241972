"""wakeline.streaming"""
