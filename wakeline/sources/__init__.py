"""wakeline.sources"""
