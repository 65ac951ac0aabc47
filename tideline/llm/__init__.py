"""Training-data operators: chat formatting, filters, near duplicates, tokens, packing, search.

Nothing outside this folder, ``tests/llm`` and ``corpus_pipeline.py`` imports it. Every operator
takes DataFrames, reads only the columns it names (other columns, whatever they are called, are
left alone) and keeps its tables in the folder that ``spark.checkpoint.dir`` names.
"""
