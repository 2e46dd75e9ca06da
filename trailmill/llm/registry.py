"""Queries of this folder by name, and SQL for those that SQL can express."""

from __future__ import annotations

from .bpe import op5_bpe
from .centroids import OP11_SQL, op11_centroids
from .exact import OP6_SQL, op6_exact
from .langid import op7_langid
from .licenses import OP13_SQL, op13_licenses
from .mixing import op4_mixing
from .polyhash import op3_fingerprints
from .quality import op9_quality
from .resample import OP12_SQL, op12_resample
from .shards import op1_shards
from .simhash import op2_simhash
from .warc import op8_warc
from .wrappers import op10_html

QUERIES = {f.__name__: f for f in (op1_shards, op2_simhash, op3_fingerprints, op4_mixing, op5_bpe, op6_exact, op7_langid, op8_warc, op9_quality, op10_html, op11_centroids, op12_resample, op13_licenses)}
SQL = {"op6_exact": OP6_SQL, "op11_centroids": OP11_SQL, "op12_resample": OP12_SQL, "op13_licenses": OP13_SQL}
