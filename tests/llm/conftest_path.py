"""The fixtures' rows, for tests that need them as values."""

import importlib.util
import os

_spec = importlib.util.spec_from_file_location("llm_conftest", os.path.join(os.path.dirname(__file__), "conftest.py"))
_module = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(_module)
documents, prose = _module.documents, _module.prose
