"""quillstone: knowledge refinement expressed as Spark jobs.

Raw text, pages and file listings are cleaned, chunked and typed into small
titled passages ("atoms"); atoms are compared with reference documents,
de-duplicated, verified, scored and published.  Every operator takes and
returns DataFrames (or Columns) and leaves the physical strategy to Catalyst.
"""
