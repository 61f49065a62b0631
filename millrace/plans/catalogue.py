"""All registered queries of the recognition-quality operators, with their SQL."""

from millrace.functions import extract, pages, script
from millrace.operators import alignment, curation, draw, draws, fields, generate, geometry, graph, metrics, pixels, readings, records, sampling, sequences, stems, variation, vocabulary, weather
from millrace.sources import queries as formats

GROUPS = (metrics.GROUP, sequences.GROUP, sampling.GROUP, curation.GROUP, fields.GROUP, alignment.GROUP, readings.GROUP, geometry.GROUP, graph.GROUP, script.GROUP, extract.GROUP, records.GROUP, pages.GROUP, generate.GROUP, pixels.GROUP, formats.GROUP, weather.GROUP, draw.GROUP, draws.GROUP, stems.GROUP, variation.GROUP, vocabulary.GROUP)
QUERIES: dict = {k: v for g in GROUPS for k, v in g.queries.items()}
SQL: dict = {k: v for g in GROUPS for k, v in g.sql.items()}
