"""Counterfactual decision analytics on Spark. The modules named here load when they are first used."""

from importlib import import_module

#: What a user imports, and the module that has it.
EXPORTS = {
    "GROUPS": "schema", "REFERENCE": "schema", "scenarios": "functions.scenarios", "stats": "functions.stats",
    "decisions": "sources.decisions", "files": "sources.files", "adapters": "sources.adapters",
    "table": "sources.table", "names": "sources.names", "mentions": "sources.mentions", "ordered": "operators.ordered",
    "matched": "operators.matched", "disparity": "operators.disparity", "paired": "operators.tests", "resample": "operators.resample",
    "anova": "operators.anova", "replay": "operators.replay", "panel": "operators.panel", "textcheck": "operators.textcheck", "report": "plans.report",
}
__all__ = list(EXPORTS)


def __getattr__(name: str):
    if name not in EXPORTS:
        raise AttributeError(f"no {name} in {__name__}")
    module = import_module(f".{EXPORTS[name]}", __name__)
    return getattr(module, name) if name.isupper() else module
