"""lectern — courseware catalogues as Spark tables.

A course tree (course → chapter → sequential → vertical → block) kept as folders of
YAML and Markdown is read as a ``files`` table and turned, with DataFrame joins,
windows and ordered aggregates, into the record sets a learning platform serves:
course documents, exams, questions, versioned card content and search documents.

Sub-packages:
  sources    scans and stand-in catalogues (files, commits, push events, XML)
  functions  Column helpers (names, paths, ids, escaping, URLs, signatures)
  operators  DataFrame → DataFrame jobs (hierarchy, rollups, records, text, validation)
  sinks      upsert, search-index and export writers
  plans      end-to-end jobs and the query registry used by the checks
  streaming  Structured Streaming push-event feed
"""

import sys as _sys

# Python helpers (vectorised UDFs) are pickled with their code, so executors need no copy
# of this package on their path (no --py-files, no shared folder).
try:
    from pyspark import cloudpickle as _cloudpickle
    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001 - older cloudpickle: fall back to shipping the package
    pass

from lectern.session import get_session, checkpoint_dir  # noqa: F401,E402

__all__ = ["get_session", "checkpoint_dir"]
