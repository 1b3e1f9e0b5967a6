"""Operators: DataFrame -> DataFrame builders."""
