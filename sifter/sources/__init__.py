"""sifter.sources"""
