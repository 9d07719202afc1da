"""photonloom.plans"""
