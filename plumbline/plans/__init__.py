"""Compositions of operators: segmentation to primitives, motion and contact reports, evaluation."""
