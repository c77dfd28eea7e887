"""paperloom.sources"""
