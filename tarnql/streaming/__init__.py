"""No streaming operators.

The dialect has no windows over event time, no watermarks and no state: a query reads
finished tables.  The package marks the place where such operators would live.
"""
