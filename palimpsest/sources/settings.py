"""Settings: files of ``key = value``, environment overrides, typed runtime variables."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field


def load(text: str, prefix: str = "PALIMPSEST_", environment: dict[str, str] | None = None) -> dict[str, str]:
    """Lines of ``key = value``; ``#`` starts a comment; PREFIX_KEY in the environment wins."""
    found = {}
    for line in text.splitlines():
        line = line.split("#", 1)[0].strip()
        if "=" in line:
            key, value = line.split("=", 1)
            found[key.strip()] = value.strip()
    environment = os.environ if environment is None else environment
    for key, value in environment.items():
        if key.startswith(prefix):
            found[key[len(prefix) :].lower()] = value
    return found


@dataclass
class Variable:
    name: str
    kind: type
    value: object
    category: str = ""
    dynamic: bool = True
    about: str = ""


def _typed(kind: type, text: object) -> object:
    if kind is bool:
        if str(text).lower() not in ("true", "false", "1", "0", "on", "off"):
            raise ValueError(f"not a truth value: {text}")
        return str(text).lower() in ("true", "1", "on")
    return kind(text)


@dataclass
class Variables:
    """A registry with change callbacks."""

    known: dict[str, Variable] = field(default_factory=dict)
    watchers: dict[str, list[Callable[[object], None]]] = field(default_factory=dict)

    def register(self, variable: Variable) -> None:
        self.known[variable.name] = variable

    def get(self, name: str) -> object:
        return self.known[name].value

    def set(self, name: str, value: object) -> None:
        variable = self.known[name]
        if not variable.dynamic:
            raise PermissionError(f"{name} is read-only")
        variable.value = _typed(variable.kind, value)
        for watcher in self.watchers.get(name, []):
            watcher(variable.value)

    def watch(self, name: str, watcher: Callable[[object], None]) -> None:
        self.watchers.setdefault(name, []).append(watcher)

    def update(self, settings: dict[str, str]) -> None:
        """What a settings file says of known variables, read-only ones too."""
        for name, value in settings.items():
            if name in self.known:
                self.known[name].value = _typed(self.known[name].kind, value)

    def listed(self, pattern: str = "%") -> list[Variable]:
        """Those whose name is like ``pattern``, by category and name."""
        core = pattern.removeprefix("%").removesuffix("%")
        left, right = pattern.startswith("%"), pattern.endswith("%")
        tests = {(True, True): str.__contains__, (True, False): str.endswith, (False, True): str.startswith, (False, False): str.__eq__}
        test = tests[left, right]
        return sorted((v for v in self.known.values() if not core or test(v.name, core)), key=lambda v: (v.category, v.name))

    def saved(self) -> str:
        return "".join(f"{v.name} = {v.value}\n" for v in self.listed())

    def frame(self, spark):
        rows = [(v.name, str(v.value), v.kind.__name__, v.category, v.dynamic, v.about) for v in self.listed()]
        return spark.createDataFrame(rows, "name string, value string, type string, category string, dynamic boolean, about string")


# Name, type, default (- for none), category, and whether it may change while running.
DEFAULTS = """
host str 0.0.0.0 server
port int 8080 server
max_connections int 128 server
request_timeout_ms int 30000 server
webui_enabled bool true webui
webui_port int 11011 webui
webui_root str web/dist webui
llm_provider str ollama provider
llm_model str qwen3:8b provider
llm_host str 127.0.0.1 provider
llm_port int 11434 provider
llm_api_key_env str OPENAI_API_KEY provider
llm_base_url str - provider
embed_provider str ollama provider
embed_model str qwen3-embedding provider
embed_host str 127.0.0.1 provider
embed_port int 11434 provider
embed_api_key_env str OPENAI_API_KEY provider
embed_base_url str - provider
embedding_dimension int 4096 provider
rerank_provider str none provider
rerank_model str - provider
pool_max_connections int 8 pool
pool_max_active_connections int 8 pool
pool_active_wait_timeout_ms int 5000 pool dynamic
pool_idle_timeout_ms int 30000 pool dynamic
pool_circuit_threshold int 5 pool dynamic
pool_circuit_cooldown_ms int 10000 pool dynamic
hnsw_max_connections int 16 hnsw
hnsw_ef_construction int 200 hnsw
hot_capacity int 50000 hnsw dynamic
cold_tier_path str - hnsw
eviction_ratio float 0.1 hnsw dynamic
decay_rate float 0.01 memory dynamic
importance_boost float 0.1 memory dynamic
stale_threshold_hours int 720 memory dynamic
conflict_similarity_threshold float 0.85 memory dynamic
semantic_weight float 0.4 retrieval dynamic
keyword_weight float 0.25 retrieval dynamic
graph_weight float 0.15 retrieval dynamic
recency_weight float 0.1 retrieval dynamic
importance_weight float 0.1 retrieval dynamic
async_worker_threads int 4 async
async_queue_capacity int 10000 async dynamic
max_recent_turns int 10 session
initial_memory_load_count int 20 session
data_dir str ./palimpsest_data storage
log_level str info storage dynamic
lsm_flush_interval int 30 storage dynamic
wal_max_size int 104857600 storage
wal_expiry_seconds int 3600 storage
sst_target_size int 4194304 storage
l0_compaction_threshold int 4 storage
level_size_multiplier int 10 storage
hnsw_save_interval int 60 storage dynamic
sst_use_mmap bool true storage
v2_write_gate_enabled bool false v2 dynamic
v2_lineage_propagation_enabled bool false v2 dynamic
v2_forget_score_enabled bool false v2 dynamic
v2_hnsw_compact_enabled bool false v2 dynamic
v2_conflict_resolver_enabled bool false v2 dynamic
v2_consolidation_enabled bool false v2 dynamic
v2_global_shadow_mode bool false v2 dynamic
v2_duplicate_threshold float 0.95 v2 dynamic
v2_low_value_threshold float 0.15 v2 dynamic
v2_deferred_threshold float 0.30 v2 dynamic
v2_forget_decay_threshold float 0.3 v2 dynamic
v2_forget_archive_threshold float 0.6 v2 dynamic
v2_forget_tombstone_threshold float 0.85 v2 dynamic
v2_conflict_llm_judge bool false v2
v2_consolidation_dedup_threshold float 0.95 v2 dynamic
v2_consolidation_drift_threshold float 0.3 v2 dynamic
"""
TYPES = {"str": str, "int": int, "float": float, "bool": bool}


def default_variables() -> Variables:
    found = Variables()
    for line in DEFAULTS.split("\n"):
        if line:
            name, kind, value, category, *dynamic = line.split()
            found.register(Variable(name, TYPES[kind], _typed(TYPES[kind], "" if value == "-" else value), category, dynamic=bool(dynamic)))
    return found


MOST_AGENTS, DEFAULT_AGENT = 100, "default"


@dataclass
class Agents:
    """The agents whose rows a store keeps apart: at most ``most``, one of which stays."""

    names: dict[str, str] = field(default_factory=lambda: {DEFAULT_AGENT: DEFAULT_AGENT})
    most: int = MOST_AGENTS
    create: bool = True

    def register(self, agent_id: str, shown: str = "") -> None:
        if agent_id in self.names:
            raise ValueError(f"there is an agent {agent_id!r}")
        if len(self.names) >= self.most:
            raise ValueError(f"no more than {self.most} agents")
        self.names[agent_id] = shown or agent_id

    def get(self, agent_id: str) -> str:
        """The shown name; an unknown agent is registered, if that is allowed."""
        if agent_id not in self.names:
            if not self.create:
                raise KeyError(agent_id)
            self.register(agent_id)
        return self.names[agent_id]

    def remove(self, agent_id: str) -> None:
        if agent_id == DEFAULT_AGENT:
            raise ValueError("the default agent stays")
        del self.names[agent_id]

    def listed(self) -> list[str]:
        return sorted(self.names)


@dataclass(frozen=True)
class Gates:
    """Which optional steps run; ``shadow`` computes without applying."""

    write_gate: bool = False
    lineage: bool = False
    forget: bool = False
    compact: bool = False
    conflicts: bool = False
    consolidation: bool = False
    reconcile: bool = False
    staleness: bool = True
    routing: bool = True
    tiered_decay: bool = False
    exponential_decay: bool = False
    promotion: bool = False
    recency_gate: bool = False
    demotion: bool = False
    shadow: bool = True

    @classmethod
    def every(cls, on: bool = True) -> Gates:
        return cls(**{name: on for name in cls.__dataclass_fields__ if name != "shadow"})

    def enabled(self) -> int:
        return sum(getattr(self, n) for n in self.__dataclass_fields__ if n != "shadow")
