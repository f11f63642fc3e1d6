"""tarnhelm: sealed and governed analytics as ordinary Spark plans.

Relational work stays in Catalyst.  The package adds what Spark lacks: sealed
(AES-GCM) tables, access tokens with an operator budget and a provenance trace,
vector column functions, a few iterative workloads and a small query service.
"""

__version__ = "0.1.0"
