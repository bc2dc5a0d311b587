"""Thresholds, lookup maps and patterns.

Everything in this module is a fixed value: results only agree with the
analyser whose behaviour we reproduce if these stay as they are.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, replace

# ---- fixed values: extension -> language (the map the report uses) ----
LANGUAGE_OF_EXTENSION = {
    ".py": "Python",
    ".js": "JavaScript",
    ".ts": "TypeScript",
    ".java": "Java",
    ".go": "Go",
    ".rs": "Rust",
    ".cpp": "C++",
    ".c": "C",
    ".cs": "C#",
    ".rb": "Ruby",
    ".php": "PHP",
    ".swift": "Swift",
    ".kt": "Kotlin",
    ".scala": "Scala",
    ".r": "R",
    ".m": "Objective-C",
    ".h": "C/C++ Header",
    ".txt": "Text",
    ".md": "Markdown",
    ".rst": "reStructuredText",
}
# ---- fixed values: two more entries of the wider map ----
EXTRA_LANGUAGES = {".ino": "Arduino", ".ps1": "PowerShell"}
UNKNOWN_LANGUAGE = "Unknown"
TEXT_LANGUAGES = ["Text", "Markdown", "reStructuredText"]

# ---- fixed values: file roles by exact name or directory ----
ROLE_PATTERNS = {
    "build": [
        "setup.py", "requirements.txt", "package.json", "Cargo.toml",
        "build.gradle", "pom.xml", "Makefile", "CMakeLists.txt",
    ],
    "config": [
        ".env", "config.yaml", "config.json", ".gitignore", "docker-compose.yml",
        "Dockerfile", "nginx.conf", "webpack.config.js", "tsconfig.json",
    ],
    "docs": [
        "README.md", "CONTRIBUTING.md", "API.md", "CHANGELOG.md",
        "docs/", "wiki/", "specifications/",
    ],
    "tests": [
        "test/", "tests/", "spec/", "__tests__/",
        "pytest.ini", "jest.config.js", "phpunit.xml",
    ],
    "ci": [
        ".github/workflows/", ".gitlab-ci.yml", "Jenkinsfile",
        "azure-pipelines.yml", ".travis.yml", ".circleci/",
    ],
}

# ---- fixed values: which files are not analysed ----
BINARY_EXTENSIONS = [
    ".deb", ".png", ".jpg", ".jpeg", ".gif", ".ico", ".exe", ".dll",
    ".so", ".dylib", ".bin", ".dat", ".db", ".sqlite", ".pyc", ".pyo",
    ".idx", ".pack", ".rev",
]
MAX_FILE_BYTES = 5 * 1024 * 1024
IGNORE_PATTERNS = ["*.min.js", "vendor/*"]
SKIPPED_DIRECTORIES = ["__pycache__", ".git", "venv", "node_modules"]

# ---- fixed values: branch keywords and name patterns of the generic analysis ----
BRANCH_PATTERNS = [
    r"\bif\b", r"\belif\b", r"\belse\b", r"\bfor\b", r"\bwhile\b", r"\bdo\b",
    r"\bswitch\b", r"\bcase\b", r"\bcatch\b", r"\bfinally\b", r"\b&&\b", r"\b\|\|\b",
]
# (pattern, group holding the name)
FUNCTION_PATTERNS = [
    (r"def\s+(\w+)\s*\(", 1),
    (r"function\s+(\w+)\s*\(", 1),
    (r"(\w+)\s*:\s*function\s*\(", 1),
    (r"(\w+)\s*=\s*function\s*\(", 1),
    (r"(\w+)\s*=\s*\([^)]*\)\s*=>", 1),
    (r"public\s+(\w+)\s+(\w+)\s*\(", 2),
    (r"private\s+(\w+)\s+(\w+)\s*\(", 2),
    (r"protected\s+(\w+)\s+(\w+)\s*\(", 2),
    (r"(\w+)\s+(\w+)\s*\(", 2),
]
CLASS_PATTERNS = [
    r"class\s+(\w+)",
    r"class\s+(\w+)\s*\{",
    r"interface\s+(\w+)",
    r"struct\s+(\w+)",
    r"enum\s+(\w+)",
]

# ---- fixed values: cache, queue and metric limits ----
CACHE_VERSION = 2
RESULT_TTL_SECONDS = 3600
BIG_PROJECT_TTL_SECONDS = 600
BIG_PROJECT_BYTES = 1_000_000
PARTITION_BYTES = 5_000_000
SOFT_LIMIT_SECONDS = 240
HARD_LIMIT_SECONDS = 300
MAX_RETRIES = 3
RUNS_PER_MINUTE = 100
DURATION_BUCKETS = [30, 60, 120, 180, 240, 300]
EVICT_FRACTION_DIVISOR = 10
CONFIDENCE = 0.8
CHUNK_SIZE = 1000

# ---- fixed values: smell texts (data, kept in Portuguese) ----
SMELL_TEXTS = {
    "long_method": ("Método muito longo (%d linhas)", 2,
                    "Divida o método em funções menores e mais específicas"),
    "long_parameter_list": ("Método com muitos parâmetros (%d)", 1,
                            "Agrupe parâmetros relacionados em uma classe ou use padrão Builder"),
    "high_complexity": ("Complexidade muito alta (%d)", 3,
                        "Simplifique o método dividindo em partes menores"),
    "large_class": ("Classe muito grande (%d linhas)", 2,
                    "Divida a classe em classes menores com responsabilidades específicas"),
    "data_class": ("Classe apenas com atributos e getters/setters", 1,
                   "Adicione comportamento à classe ou considere usar @dataclass"),
    "god_class": ("Classe com muitas responsabilidades", 3,
                  "Divida a classe em classes menores com responsabilidades únicas"),
    "duplicate_code": ("Código duplicado (linhas %d-%d)", 2,
                       "Extraia o código duplicado para um método reutilizável"),
}
GOD_CLASS_METHODS = 20
GOD_CLASS_ATTRIBUTES = 15

# ---- fixed values: request and summary texts ----
EMPTY_PATH_MESSAGE = "Caminho não pode ser vazio"
MISSING_PATH_MESSAGE = "Caminho não existe: "
DONE_MESSAGE = "Análise concluída"
NO_SUMMARY_TEXT = "Não foi possível gerar um resumo do texto."
REVIEW_BODY = "Análise automática"

# ---- fixed values: prompts (head, text, tail) ----
SUMMARY_TAIL = "\n\nPor favor, forneça o resumo em português do Brasil.\n"
SUMMARY_PROMPTS = {
    "Arduino": (
        "Analise o seguinte código Arduino e forneça um resumo detalhado:\n\n",
        "\n\nO resumo deve incluir:\n1. Propósito do código\n2. Funcionalidades principais\n"
        "3. Componentes e periféricos utilizados\n4. Considerações de hardware\n"
        "5. Possíveis melhorias" + SUMMARY_TAIL,
    ),
    "PowerShell": (
        "Analise o seguinte script PowerShell e forneça um resumo detalhado:\n\n",
        "\n\nO resumo deve incluir:\n1. Objetivo do script\n2. Comandos principais\n"
        "3. Interações com o sistema\n4. Considerações de segurança\n"
        "5. Possíveis melhorias" + SUMMARY_TAIL,
    ),
    "C/C++ Header": (
        "Analise o seguinte arquivo de cabeçalho C/C++ e forneça um resumo detalhado:\n\n",
        "\n\nO resumo deve incluir:\n1. Propósito do arquivo\n2. Definições e estruturas principais\n"
        "3. Funções e macros\n4. Dependências\n5. Possíveis melhorias" + SUMMARY_TAIL,
    ),
}
DEFAULT_SUMMARY_PROMPT = (
    "Analise o seguinte texto e forneça um resumo conciso e informativo:\n\n",
    "\n\nO resumo deve incluir:\n1. Tema principal\n2. Pontos chave\n"
    "3. Conclusões ou recomendações (se houver)" + SUMMARY_TAIL,
)
CODE_PROMPT = (
    "Analise o seguinte código ", " e forneça sugestões de melhorias:\n\n",
    "\n\nPor favor, forneça sugestões específicas para melhorar:\n1. Legibilidade\n2. Performance\n"
    "3. Boas práticas\n4. Segurança\n5. Manutenibilidade\n\nFormato da resposta:\n"
    "- Linha X: Descrição do problema\n  Sugestão: Código sugerido\n"
    "  Explicação: Por que essa mudança é importante\n",
)
PYTHON_CODE_PROMPT = (
    "Analise este código Python e sugira melhorias em português:\n\n",
    "\n\nForneça sugestões no seguinte formato:\n\nLinha X:\nOriginal: <código original>\n"
    "Sugestão: <código sugerido>\nExplicação: <explicação da melhoria>\n\nExemplo:\nLinha 10:\n"
    "Original: def func():\nSugestão: def process_data():\n"
    "Explicação: Nome da função mais descritivo para melhor legibilidade",
)

# ---- fixed values: domain event types ----
DOMAIN_EVENT_TYPES = [
    "workspace.created", "workspace.deleted", "changes.applied", "changes.failed",
    "analysis.started", "analysis.completed", "analysis.failed",
]


# ---- fixed values: names and defaults of the thresholds ----
@dataclass(frozen=True)
class Thresholds:
    """Limits of the smell rules; every comparison with them is strict."""

    max_method_lines: int = 30
    max_complexity: int = 10
    max_class_lines: int = 300
    max_parameters: int = 5
    min_duplicate_lines: int = 6
    min_similarity: float = 0.8


@dataclass(frozen=True)
class EngineConfig:
    """Run options. A JSON document overrides top-level keys only."""

    thresholds: Thresholds = field(default_factory=Thresholds)
    chunk_size: int = CHUNK_SIZE
    ignore_patterns: tuple[str, ...] = tuple(IGNORE_PATTERNS)
    languages: dict[str, str] = field(default_factory=lambda: dict(LANGUAGE_OF_EXTENSION))
    roles: dict[str, list[str]] = field(default_factory=lambda: dict(ROLE_PATTERNS))


def config_from_json(text: str | None) -> EngineConfig:
    """Defaults with top-level keys replaced; a replaced map is not merged."""
    base = EngineConfig()
    given = json.loads(text) if text else {}
    limit_names = {f.name for f in fields(Thresholds)}
    limits = {k: v for k, v in given.items() if k in limit_names}
    renamed = {"language_extensions": "languages", "important_files": "roles"}
    own = {renamed.get(k, k): v for k, v in given.items()}
    own = {k: v for k, v in own.items() if k in {"chunk_size", "ignore_patterns", "languages", "roles"}}
    if "ignore_patterns" in own:
        own["ignore_patterns"] = tuple(own["ignore_patterns"])
    return replace(base, thresholds=replace(base.thresholds, **limits), **own)


@dataclass(frozen=True)
class Cohort:
    name: str
    weight: float
    description: str = ""
    params: dict = field(default_factory=dict)

    def __post_init__(self):
        if not 0 <= self.weight <= 1:
            raise ValueError(f"cohort {self.name}: weight must lie in [0, 1]")


def cohorts_from_mapping(document: dict) -> list[Cohort]:
    """Cohorts of a parsed A/B document, in document order, weights checked."""
    return [
        Cohort(name, float(body["weight"]), body["description"], dict(body["params"]))
        for name, body in document["cohorts"].items()
    ]
