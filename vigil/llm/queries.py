"""All registered queries of the subpackage (importing a module registers its queries)."""

from vigil.llm import conversations, decontam, exact, filter_audit, langid, license, mixing, packing, simhash, spans, suffixes, tokens, warc  # noqa: F401
from vigil.llm.base import ORACLES, QUERIES  # noqa: F401
