"""wakeline.plans"""
