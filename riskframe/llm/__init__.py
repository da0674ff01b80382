"""Operators for preparing training data: one module per operator, all on DataFrames of documents.

Every operator takes whole tables and returns whole results. Texts are read as
UTF-8 bytes inside Arrow batches where Python is needed; what has to be kept
between steps is cut with ``checkpoint`` to the shared folder.
"""
