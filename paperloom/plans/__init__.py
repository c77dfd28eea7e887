"""paperloom.plans"""
