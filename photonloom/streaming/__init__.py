"""photonloom.streaming"""
