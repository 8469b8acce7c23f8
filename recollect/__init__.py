"""Long-term memory and knowledge compilation as Spark DataFrame operators.

Sub-packages: ``functions`` (column expressions), ``operators`` (DataFrame to
DataFrame), ``sources`` (scans and sinks), ``plans`` (composed pipelines and the
driver's query registry), ``streaming`` and ``serve``.  The optional ``llm``
sub-package holds corpus preparation operators; nothing outside it imports it.

The names below are the library's entry points; each is loaded when first used.
"""

from __future__ import annotations

import importlib

__version__ = "0.2.0"

#: Entry points by the module that defines them.
_EXPORTS = {
    "recollect.session": ("local_session",),
    "recollect.sources.vault": ("Vault",),
    "recollect.plans.engine": ("Index", "search"),
    "recollect.plans.ingest": ("dream_cycle",),
    "recollect.operators.retrieval": ("SearchIndex", "build_index", "index_documents", "bm25", "exact", "vector_search"),
    "recollect.operators.hooks": ("Hook", "Registry"),
}

__all__ = ["__version__", *(name for names in _EXPORTS.values() for name in names)]


def __getattr__(name: str):
    for module, names in _EXPORTS.items():
        if name in names:
            return getattr(importlib.import_module(module), name)
    raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
