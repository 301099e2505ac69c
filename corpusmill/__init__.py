"""corpusmill: build, select and evaluate image-text corpora as Spark jobs.

Sub-packages:

* ``functions``  native Column expressions (vector math, text, seeded hashing)
* ``sources``    scans and sinks (tar shards, delimited files, manifests, folders, XML)
* ``operators``  DataFrame -> DataFrame operators (corpus assembly, inference
                 fan-out, similarity, caption selection, sampling, zero-shot
                 evaluation, metrics, exact global index)
* ``plans``      bindings of the operators to the test tables and the registered queries
* ``streaming``  the stateless selection operators run under ``readStream``
"""

from corpusmill.session import checkpoint_dir, get_session, reliable_checkpoint

__all__ = ["get_session", "checkpoint_dir", "reliable_checkpoint"]
