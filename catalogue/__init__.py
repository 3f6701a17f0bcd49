"""Queries of the driver contract: every operator run over the supplied tables, with its SQL oracle.

The supplied tables hold no audio or rasters, so each operator runs on a table of the same shape: orders play
recordings, line items play annotations or composites, customers play points, embeddings play 8×8 rasters.
"""
