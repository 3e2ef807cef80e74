"""triage — forensic table analytics expressed as Spark DataFrame plans.

Sub-packages:
  sources    lossless CSV / text / binary-file scans and sinks
  functions  Column -> Column expressions (cell cleanup, numbers, IPs, conversions)
  operators  alias resolution, lookups, detectors, profiling, validation, enrichment
  plans      derived views, query registry, oracle SQL, the end-to-end pipeline
  streaming  the per-row detectors over a file-source stream
"""

from triage.table import ForensicTable

__all__ = ["ForensicTable"]
