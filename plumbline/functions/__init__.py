"""Scalar functions: column expressions over numbers and ``array<double>`` vectors and matrices.

Matrices are row-major arrays, quaternions wxyz. Every function takes and returns columns and stays
in the JVM; nothing here runs Python on executors.
"""
