"""icx — in-context translation studies as Spark DataFrame programs.

Subpackages:
  functions  column-level building blocks (seeded hashing, Python-compatible text
             splitting, script tables)
  sources    loaders for pair tables, dense indexes, corpus fan-out and sinks
  operators  perturbations, demonstration sampling, prompt composition, generation
             data path, corpus metrics, pivot study
  plans      experiment grids and the end-to-end grid job
  streaming  stateless prompt composition over a streaming test table
"""

__version__ = "0.1.0"
