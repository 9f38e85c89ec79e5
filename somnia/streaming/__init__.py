"""No streaming operators.

The workload is bounded: recordings are complete before they are analysed.
Fixed epochs are tumbling windows and sequences are sliding windows over
tables, so everything lives in ``somnia.operators``.
"""
