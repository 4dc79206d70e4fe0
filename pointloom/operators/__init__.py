"""Point-cloud operators: DataFrame in, DataFrame out, keyword parameters.

A cloud has at least id (long), x, y, z (double); other columns pass through where an
operator keeps points. Edges have src, dst, d2 and the end points' coordinates.
"""
