"""python scripts/compare_core.py [MODULE]: the queries of a module of quietcount.plans against their SQL."""

import importlib
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import compare  # noqa: E402

sys.exit(compare.main(list(importlib.import_module(f"quietcount.plans.{sys.argv[1]}").QUERIES)))
