"""Versioned configuration: merge policy, confidence rules, aliases, validation limits, projection rules."""

from __future__ import annotations

from dataclasses import dataclass, field

from goldrec.schema import CONTACT_FIELDS

STRATEGIES = ("source_priority", "first_non_empty", "highest_confidence", "union")
SOURCES = ("ATS", "RESUME")
LISTS = ("skills", "languages")
STRUCTURED = ("experiences", "education", "certifications")
FIELDS = ("external_id", "first_name", "last_name", "experiences", "education", "skills", "certifications", "languages", *(f"contact.{c}" for c in CONTACT_FIELDS))


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class Rule:
    strategy: str = "source_priority"
    priority: tuple[str, ...] = SOURCES
    identity: tuple[str, ...] = ()


#: How each field is merged.
DEFAULT_RULES = {
    "external_id": Rule(),
    "first_name": Rule(),
    "last_name": Rule(),
    "contact.email": Rule(),
    "contact.phone": Rule(),
    "contact.location": Rule("first_non_empty"),
    "contact.linkedin_url": Rule("first_non_empty", ("RESUME", "ATS")),
    "contact.github_url": Rule("first_non_empty", ("RESUME", "ATS")),
    "skills": Rule("union", ("RESUME", "ATS")),
    "languages": Rule("union"),
    "certifications": Rule("union", identity=("name", "issuer")),
    "experiences": Rule("union", identity=("company", "title", "start_date")),
    "education": Rule("union", identity=("institution", "degree")),
}

#: Canonical spellings of skills, by lower-case alias.
SKILL_ALIASES = {
    "js": "JavaScript", "javascript": "JavaScript", "ts": "TypeScript", "typescript": "TypeScript", "py": "Python", "python": "Python",
    "golang": "Go", "go": "Go", "reactjs": "React", "react.js": "React", "react": "React", "nodejs": "Node.js", "node.js": "Node.js",
    "node": "Node.js", "postgres": "PostgreSQL", "postgresql": "PostgreSQL", "k8s": "Kubernetes", "kubernetes": "Kubernetes",
    "aws": "AWS", "amazon web services": "AWS", "gcp": "GCP", "google cloud platform": "GCP", "ml": "Machine Learning",
    "machine learning": "Machine Learning", "ai": "Artificial Intelligence", "csharp": "C#", "c#": "C#", "cplusplus": "C++", "c++": "C++",
    "chromedb": "ChromaDB", "chromadb": "ChromaDB", "openai gpt": "OpenAI GPT", "whisper asr": "Whisper", "langchain & chromadb": "LangChain",
}


@dataclass(frozen=True)
class Policy:
    rules: dict[str, Rule] = field(default_factory=lambda: dict(DEFAULT_RULES))

    def __post_init__(self):
        for name, rule in self.rules.items():
            if name not in FIELDS:
                raise ConfigError(f"unknown field {name}")
            if rule.strategy not in STRATEGIES:
                raise ConfigError(f"{name}: unknown strategy {rule.strategy}")
            if not rule.priority or set(rule.priority) - set(SOURCES):
                raise ConfigError(f"{name}: bad priority {rule.priority}")
            if (rule.strategy == "union") != (name in LISTS + STRUCTURED):
                raise ConfigError(f"{name}: {rule.strategy} does not fit this kind of field")
            if name in STRUCTURED and not rule.identity:
                raise ConfigError(f"{name}: a union of records needs identity keys")

    def rule(self, name: str) -> Rule:
        return self.rules.get(name, Rule())


@dataclass(frozen=True)
class Scoring:
    """Weights of sources and fields, the agreement bonus, the conflict penalty, the order of steps."""

    sources: dict[str, float] = field(default_factory=lambda: {"ATS": 0.7, "RESUME": 0.6})
    fields: dict[str, float] = field(default_factory=lambda: {"first_name": 1.0, "last_name": 1.0, "contact": 1.5, "experiences": 2.0, "education": 1.0, "skills": 0.5})
    steps: tuple[str, ...] = ("source_weight", "agreement", "conflict_penalty", "missing_field")
    bonus: float = 0.1
    penalty: float = 0.2

    def __post_init__(self):
        known = {"source_weight", "agreement", "conflict_penalty", "missing_field"}
        if set(self.steps) - known:
            raise ConfigError(f"unknown scoring steps {sorted(set(self.steps) - known)}")


@dataclass(frozen=True)
class Config:
    policy: Policy = field(default_factory=Policy)
    scoring: Scoring = field(default_factory=Scoring)
    aliases: dict[str, str] = field(default_factory=lambda: dict(SKILL_ALIASES))
    longest: int = 10_000
    region: str = "US"


def load_yaml(path: str, low: str = "1.0", high: str = "1.0") -> dict:
    """A YAML mapping with a `version` between low and high; everything else is a ConfigError."""
    import yaml

    try:
        with open(path, encoding="utf-8") as file:
            data = yaml.safe_load(file)
    except (OSError, yaml.YAMLError) as error:
        raise ConfigError(f"{path}: {error}") from error
    if not isinstance(data, dict):
        raise ConfigError(f"{path}: not a mapping")
    version = data.get("version")
    if not isinstance(version, str) or not version.strip() or not low <= version <= high:
        raise ConfigError(f"{path}: version {version!r} is not supported")
    return data


def load_policy(path: str) -> Policy:
    data = load_yaml(path)
    usual = Rule(data.get("default_strategy", "source_priority"), tuple(data.get("default_priority", SOURCES)))
    return Policy({name: Rule(r.get("strategy", usual.strategy), tuple(r.get("priority", usual.priority)), tuple(r.get("identity_keys", ()))) for name, r in (data.get("fields") or {}).items()})


def _section(data: dict, path: str, name: str, kind: type, default=None):
    found = data.get(name, default)
    if not isinstance(found, kind):
        raise ConfigError(f"{path}: {name} is missing or not a {kind.__name__}")
    return found


def load_scoring(path: str) -> Scoring:
    """source_weights, scored_fields (in order) with their field_weights, strategy_order."""
    data = load_yaml(path)
    weights = _section(data, path, "field_weights", dict)
    fields = {name: float(weights.get(name, 1.0)) for name in _section(data, path, "scored_fields", list)}
    return Scoring({k: float(v) for k, v in _section(data, path, "source_weights", dict).items()}, fields, tuple(_section(data, path, "strategy_order", list)))


def load_projection(path: str) -> dict[str, dict[str, str]]:
    """Dotted path of a field -> {"output": its name}."""
    fields = _section(load_yaml(path), path, "fields", dict)
    if not fields or any(not isinstance(r, dict) or "output" not in r for r in fields.values()):
        raise ConfigError(f"{path}: fields need a mapping with an output each")
    return fields


def load_config(folder: str) -> Config:
    """A run's configuration from those of merge_policy, confidence_rules, validation_rules and skill_aliases (.yaml) that
    the folder has; the usual values stand for the others."""
    import os

    at = lambda name: os.path.join(folder, f"{name}.yaml")
    has = lambda name: os.path.exists(at(name))
    given: dict = {}
    if has("merge_policy"):
        given["policy"] = load_policy(at("merge_policy"))
    if has("confidence_rules"):
        given["scoring"] = load_scoring(at("confidence_rules"))
    if has("skill_aliases"):
        given["aliases"] = load_aliases(at("skill_aliases"))
    if has("validation_rules"):
        limits = load_yaml(at("validation_rules"))
        given |= {"longest": int(limits.get("max_string_length", Config.longest)), "region": str(limits.get("default_phone_region", Config.region))}
    return Config(**given)


def load_aliases(path: str) -> dict[str, str]:
    return {str(k).lower(): str(v) for k, v in (load_yaml(path).get("aliases") or {}).items()}
