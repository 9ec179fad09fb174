"""sifter.functions"""
