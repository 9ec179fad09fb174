"""sifter.operators"""
