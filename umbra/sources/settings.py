"""Settings from files and the environment: rules, banned phrases, prompts and any other configuration."""

from __future__ import annotations

import json
import os
from pathlib import Path

from umbra.functions import fixed
from umbra.operators.detection import Rule, load_rules

#: Environment variables that name files of rules to use instead of the built-in ones, by language.
RULE_FILES = {"zh": "REGEX_RULES_FILE", "en": "REGEX_EN_RULES_FILE"}
#: Keys of a configuration whose list holds the banned phrases, in this order.
PHRASE_KEYS = ("banned_phrases", "phrases", "banned")
#: Columns to look for in datasets of pairs, by corpus: that of the original, that of the masked text.
PAIR_CORPORA = {
    "pii-masking-300k": (
        ("original_text", "source_text", "text", "input"),
        ("masked_text", "anonymized_text", "masked", "output", "target", "target_text"),
    ),
    "nemotron-pii": (
        ("original_text", "source_text", "text", "input", "prompt"),
        ("masked_text", "anonymized_text", "masked", "output", "target", "completion", "text_tagged"),
    ),
}
#: Label names by number in datasets of tokens; None where tags are names already.
TOKEN_CORPORA = {"wikiann": ("O", "B-PER", "I-PER", "B-ORG", "I-ORG", "B-LOC", "I-LOC"), "msra_ner": None, "weibo_ner": None}


def loaded(path: str) -> object:
    """The content of a JSON or YAML file, by its extension; of another, YAML where it can be read so, else JSON."""
    text, ext = Path(path).expanduser().read_text(encoding="utf-8"), os.path.splitext(path)[1].lower()
    if ext == ".json":
        return json.loads(text)
    import yaml

    if ext in (".yaml", ".yml"):
        return yaml.safe_load(text)
    try:
        return yaml.safe_load(text)
    except yaml.YAMLError:
        return json.loads(text)


def banned_phrases(path: str) -> list[str]:
    """Phrases of a list, or of the list under one of PHRASE_KEYS; blank ones are left out; no content has none."""
    data = loaded(path)
    if isinstance(data, dict):
        data = next((data[k] for k in PHRASE_KEYS if data.get(k)), [])
    if data is None:
        return []
    if not isinstance(data, list):
        raise ValueError(f"no list of phrases in {path}")
    return [str(x) for x in data if str(x).strip()]


def prompt_template(path: str) -> str:
    """A prompt with {RAW_TEXT} in it."""
    return Path(path).expanduser().read_text(encoding="utf-8")


def rules(language: str = "en", env: dict[str, str] | None = None) -> list[Rule]:
    """The rules of a language: those of the file that the environment names, else the built-in ones."""
    named = (os.environ if env is None else env).get(RULE_FILES.get(language, ""))
    return load_rules(named) if named else list(fixed.RULES[language])


def unknown_keys(data: dict, known: set[str]) -> list[str]:
    """The keys of a configuration that nothing reads."""
    return sorted(set(data) - known)
