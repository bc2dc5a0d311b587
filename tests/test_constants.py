"""Values the SQL twins share with the operators, against what they must be."""

import dataclasses

from codeloom import settings


def test_thresholds():
    assert dataclasses.asdict(settings.Thresholds()) == {
        "max_method_lines": 30, "max_complexity": 10, "max_class_lines": 300, "max_parameters": 5,
        "min_duplicate_lines": 6, "min_similarity": 0.8}
    assert (settings.GOD_CLASS_METHODS, settings.GOD_CLASS_ATTRIBUTES) == (20, 15)


def test_limits():
    assert (settings.CACHE_VERSION, settings.RESULT_TTL_SECONDS, settings.BIG_PROJECT_TTL_SECONDS) == (2, 3600, 600)
    assert (settings.BIG_PROJECT_BYTES, settings.PARTITION_BYTES, settings.MAX_FILE_BYTES) == (
        1_000_000, 5_000_000, 5_242_880)
    assert (settings.SOFT_LIMIT_SECONDS, settings.HARD_LIMIT_SECONDS) == (240, 300)
    assert (settings.MAX_RETRIES, settings.RUNS_PER_MINUTE, settings.CHUNK_SIZE, settings.CONFIDENCE) == (3, 100, 1000, 0.8)
    assert settings.DURATION_BUCKETS == [30, 60, 120, 180, 240, 300]


def test_languages_and_files():
    languages = settings.LANGUAGE_OF_EXTENSION
    assert len(languages) == 20 and languages[".py"] == "Python" and languages[".h"] == "C/C++ Header"
    assert languages[".cs"] == "C#" and languages[".rst"] == "reStructuredText" and ".ino" not in languages
    assert settings.EXTRA_LANGUAGES == {".ino": "Arduino", ".ps1": "PowerShell"}
    assert settings.TEXT_LANGUAGES == ["Text", "Markdown", "reStructuredText"]
    assert len(settings.BINARY_EXTENSIONS) == 19 and {".png", ".pyc", ".pack"} <= set(settings.BINARY_EXTENSIONS)
    assert settings.IGNORE_PATTERNS == ["*.min.js", "vendor/*"]
    assert settings.SKIPPED_DIRECTORIES == ["__pycache__", ".git", "venv", "node_modules"]
    assert {k: len(v) for k, v in settings.ROLE_PATTERNS.items()} == {
        "build": 8, "config": 9, "docs": 7, "tests": 7, "ci": 6}


def test_patterns_and_texts():
    assert (len(settings.BRANCH_PATTERNS), len(settings.FUNCTION_PATTERNS), len(settings.CLASS_PATTERNS)) == (12, 9, 5)
    assert {k: v[1] for k, v in settings.SMELL_TEXTS.items()} == {
        "long_method": 2, "long_parameter_list": 1, "high_complexity": 3, "large_class": 2, "data_class": 1,
        "god_class": 3, "duplicate_code": 2}
    assert settings.SMELL_TEXTS["duplicate_code"][0] == "Código duplicado (linhas %d-%d)"
    assert settings.NO_SUMMARY_TEXT == "Não foi possível gerar um resumo do texto."
    assert len(settings.DOMAIN_EVENT_TYPES) == 7
