"""photonloom.functions"""
