"""Fixed values of the ranking: weights, mixes, limits; pure functions on the driver."""

from __future__ import annotations

# Fixed values: (lexical, graph, semantic, memory) weights by mode.
MODE_WEIGHTS = {
    "understand": (1.0, 0.7, 0.8, 0.7),
    "refactor": (0.8, 1.0, 0.7, 0.9),
    "bugfix": (1.0, 0.8, 0.8, 0.8),
    "testgen": (0.7, 1.0, 0.6, 0.3),
    "docs": (0.8, 0.4, 0.8, 0.9),
    "architecture": (0.7, 0.9, 0.8, 1.0),
}
CHANGE_MODES = ("refactor", "bugfix", "testgen")
SYMBOL_SEED_TYPES = ("FILE_CONTAINS_SYMBOL", "TEST_COVERS_SYMBOL", "DOC_DESCRIBES_SYMBOL", "DOC_DESCRIBES_FILE", "CONFIG_AFFECTS_FILE", "APPLIES_TO")
FILE_SEED_TYPES = ("FILE_IMPORTS_FILE", *SYMBOL_SEED_TYPES)
MEMORY_SEED_TYPES = ("APPLIES_TO", "CONSTRAINS", "WARNS_ABOUT", "IMPLEMENTED_BY", "FILE_CONTAINS_SYMBOL")
SEEDS = {"symbol": 4, "file": 3, "memory": 3}
PACKED_FILES, SNIPPETS = 8, 6

# Fixed values: (code, test, doc, config) files by mode, for selection and for packing.
SELECT_MIX = {"docs": (2, 1, 3, 2), "architecture": (3, 0, 3, 1), "change": (4, 2, 1, 1), "other": (4, 1, 2, 1)}
PACK_MIX = {"docs": (2, 1, 3, 2), "architecture": (2, 0, 3, 1), "change": (4, 2, 1, 1), "other": (3, 1, 2, 1)}


def _base(mix: dict, mode: str) -> list[int]:
    return list(mix[mode if mode in mix else "change" if mode in CHANGE_MODES else "other"])


def shrink(mix: list[int], limit: int) -> tuple[int, int, int, int]:
    """Take away one at a time from the first entry above its minimum (code 2, others 1 if any) until the sum fits."""
    least = [2] + [min(1, n) for n in mix[1:]]
    while sum(mix) > limit:
        above = [i for i in range(4) if mix[i] > least[i]]
        if not above:
            break
        mix[above[0]] -= 1
        least[1:] = [min(1, n) for n in mix[1:]]
    return tuple(mix)


def select_mix(mode: str, doc: bool, config: bool, test: bool, limit: int) -> tuple[int, int, int, int]:
    """How many code, test, doc and config files the selection takes first."""
    code, tests, docs, configs = _base(SELECT_MIX, mode)
    explains = mode in ("docs", "architecture")
    if doc:
        docs, code = max(docs, 3 if explains else 2), max(2, code - 1)
    if config:
        configs = max(configs, 2)
        docs = max(docs, 2) if explains or mode == "understand" else docs
    return shrink([code, max(tests, 2) if test else tests, docs, configs], limit)


def pack_mix(mode: str, doc: bool, config: bool, test: bool) -> tuple[int, int, int, int]:
    """How many code, test, doc and config files the packed context takes first."""
    code, tests, docs, configs = _base(PACK_MIX, mode)
    broad = mode in ("docs", "architecture", "understand")
    if doc:
        docs, code = max(docs, 2 if mode in ("refactor", "bugfix") else 3), max(2, code - 1)
    if config:
        configs = max(configs, 2 if broad else 1)
        docs = max(docs, 2) if broad else docs
    return shrink([code, max(tests, 2) if test else tests, docs, configs], PACKED_FILES)


def quotas(mode: str, limit: int) -> tuple[int, int, int]:
    """Selected files, symbols and memories."""
    return max(limit, 8), max(4, min(limit, 6)), 3 if mode in ("architecture", "docs", "refactor") else 2


def pack_limits(mode: str) -> tuple[int, int]:
    """Packed symbols and memories."""
    symbols = 4 if mode in ("docs", "architecture") else 6 if mode in CHANGE_MODES else 5
    return symbols, 3 if mode in ("docs", "architecture", "refactor") else 2
