"""Layout noise, put into the driver's documents by expressions that Spark SQL and DuckDB read alike.

The documents have none of the noise that the cleaners remove, so queries over them as they are would be passed by
doing nothing. NL is a line end; every expression keys its noise on doc_id.
"""

NL = "chr(10)"
ODD = f"(text || {NL})"

SPACES = "replace(replace(text, '. ', '. ' || chr(9) || chr(10)), 'fi', 'ﬁ') || CASE WHEN doc_id % 3 = 0 THEN chr(10) || chr(10) || chr(10) || chr(10) || '„x‟' WHEN doc_id % 5 = 0 THEN chr(13) || chr(10) || 'y  ' ELSE '' END"
KERNED = f"'C H A P T E R   1 ' || CAST(doc_id % 10 AS STRING) || {NL} || 'C h A P' || {NL} || text"
NUMBERED = f"text || {NL} || CAST(doc_id AS STRING) || {NL} || '— ' || CAST(doc_id AS STRING) || ' —' || {NL} || '3 | foo' || {NL} || 'foo bar | 47' || {NL} || '1. foo' || {NL} || '204 is the answer' || {NL} || '---' || {NL} || ' 12  Chapter Two'"
BULLETED = f"text || {NL} || '• one' || {NL} || '  ‣  two' || {NL} || '– three' || {NL} || 'a • b' || {NL} || '▪ ' || CAST(doc_id AS STRING)"
NOTED = f"replace(text, ' the ', ' the¹² ') || {NL} || 'see [3]' || {NL} || 'a [4] b' || {NL} || 'last ⁵ and [12]  '"
HEADED = f"text || {NL} || 'Chapter ' || CAST(doc_id AS STRING) || ': X' || {NL} || '1.1 Y' || {NL} || '1.1.1 Z' || {NL} || {NL} || 'ALL CAPS LINE' || {NL} || 'text' || {NL} || '2.10 Next'"
TITLED = f"'# One' || {NL} || text || {NL} || CASE WHEN doc_id % 2 = 0 THEN '# Two' || {NL} || 'x' || {NL} || '# Three' ELSE '## Two' END"
MARKED = f"'# Book ' || CAST(doc_id AS STRING) || {NL} || 'start' || {NL} || '## Part A' || {NL} || text || {NL} || '### Sub part' || {NL} || 'x' || {NL} || '## Part B' || {NL} || 'end'"
WRAPPED = f"replace(text, ', ', ',' || {NL}) || {NL} || '- item' || {NL} || 'more  text' || {NL} || 'goes on' || {NL}"
PAGED = f"'Book ' || CAST(doc_id % 7 AS STRING) || {NL} || text"
CODED = f"text || {NL} || '    def f(self):' || {NL} || '        pass' || {NL} || 'end' || {NL} || '    alone'"
FRONTED = f"CASE WHEN doc_id % 2 = 0 THEN '---' || {NL} || 'title: x' || {NL} || '---' || {NL} || {NL} ELSE '' END || text"
