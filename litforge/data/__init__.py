"""Word lists and tables that the operators read; each is a plain file, and every operator takes another one as a parameter."""

from __future__ import annotations

import json
from functools import cache
from importlib.resources import files


@cache
def load(name: str):
    """The content of a JSON file of this folder."""
    return json.loads((files(__package__) / f"{name}.json").read_text(encoding="utf-8"))
