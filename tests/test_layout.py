import re
from collections import Counter
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_base_names_of_test_files_are_unique():
    names = Counter(p.name for p in (ROOT / "tests").rglob("test_*.py"))
    assert [n for n, count in names.items() if count > 1] == []


def test_only_the_corpus_files_import_the_corpus_operators():
    own = [p for p in (ROOT / "trialweave").rglob("*.py") if "llm" not in p.relative_to(ROOT).parts]
    own += [p for p in (ROOT / "tests").glob("*.py")] + [ROOT / "bench.py", *(ROOT / "tools").glob("*.py")]
    assert [p.name for p in own if re.search(r"^\s*(from|import) (trialweave\.llm|corpus_pipeline)", p.read_text(), re.M)] == []
