"""loomtext: corpus preparation and token statistics as Spark DataFrame operators.

Every public operator takes and returns DataFrames (plus keyword parameters).
Only the BPE training loop and the ordered shard carry bring single rows back
to the driver; everything else stays a lazy plan for Catalyst.
"""

__version__ = "0.1.0"
