"""Operators: DataFrame -> DataFrame functions built from DataFrame/SQL primitives."""
