"""photonloom.sources"""
