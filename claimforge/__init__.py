"""claimforge: an evidence-first entity analytics engine written for Spark.

Layers (each one only imports those above it):

* ``lexicon``     - word lists, weights and thresholds, as plain data
* ``functions``   - pure Column expressions
* ``operators``   - DataFrame -> DataFrame transforms
* ``sources``     - readers, writers and keyed stores
* ``streaming``   - the same transforms over arriving data
* ``plans``       - named queries and the SQL they are checked against

``claimforge.llm`` (training-data operators) is optional and imported by nothing here.
"""
