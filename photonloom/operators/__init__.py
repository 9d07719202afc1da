"""photonloom.operators"""
