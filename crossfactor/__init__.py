"""Separability analytics on Spark: does a table of measurements factor into row effects times column effects?"""
