"""sifter.plans"""
