"""Settings that change results, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class IngestConfig:
    chunk_size: int = 800
    chunk_overlap: int = 120
    min_coverage: float = 0.3
    rows_per_block: int = 20
    batch: int = 32
    structural: bool = True
    ocr: bool = True
    extraction_tokens: int = 1024
    #: Seconds that the conversion of an old office file may take: base, more per MB, at most.
    convert_seconds: tuple[int, int, int] = (60, 10, 600)


@dataclass(frozen=True)
class RetrievalConfig:
    top_k: int = 5
    graph_expand: int = 5
    min_score: float = 0.3
    rrf_k: int = 60
    weights: tuple[tuple[str, float], ...] = (("vector", 1.0), ("entity_name", 1.3), ("graph", 0.8), ("keyword", 0.6))
    candidate_factor: int = 3
    keyword_pool: int = 500
    per_doc_cap: int = 3
    path_hops: int = 4
    path_pairs: int = 3
    #: Whether a path may go from entity to entity by a document that mentions both.
    through_documents: bool = False
    excluded_types: tuple[str, ...] = ("DATE",)
    near_dup: float = 0.6
    neighbour_window: int = 1
    neighbour_top: int = 3
    history_turns: int = 4
    grade_threshold: float = 5.0
    enough_ratio: float = 0.4
    max_retries: int = 2
    sub_questions: int = 4
    #: Steps that ask a model, off by default.
    condense: bool = False
    expansion: bool = False
    expansion_count: int = 2
    rerank: bool = False
    rerank_pool: int = 2
    agentic: bool = False
    #: Where a channel but the vectors fails, the others answer.
    fail_soft: bool = True
    show_sources: bool = True
    system_prompt: str = (
        "You answer questions. The context below was found in a collection and may or may not fit the question. Where it fits, use it "
        "and name the document that a fact comes from; where it doesn't, leave it aside and answer from what you know."
    )

    def __post_init__(self) -> None:
        if not 1 <= self.top_k <= 20 or not 0 <= self.graph_expand <= 20 or not 0 <= self.min_score <= 1:
            raise ValueError("top_k must be 1 to 20, graph_expand 0 to 20 and min_score 0 to 1")


# The kinds of entity, the words that are no keywords, and the parts of field names
# that tell the kind of a field's value (the first group that fits counts).
ENTITY_TYPES = (
    "PERSON", "ORGANIZATION", "THREAT_ACTOR", "MALWARE", "VULNERABILITY", "INDICATOR", "PRODUCT", "LOCATION",
    "FACILITY", "MILITARY_UNIT", "WEAPON", "OPERATION", "LAW", "EVENT", "DATE", "CONCEPT",
)
STOPWORDS = (
    "the", "a", "an", "is", "are", "was", "were", "of", "in", "on", "at", "to", "for", "and", "or", "but", "with", "about", "tell", "me", "what",
    "who", "when", "where", "why", "how", "does", "do", "did", "this", "that", "these", "those", "it", "its", "as", "by", "from", "be", "been",
    "has", "have", "had", "can", "could", "would", "should",
)
KEY_HINTS = (
    ("THREAT_ACTOR", ("threat_actor", "threatactor", "adversary", "attacker", "actor", "intrusion_set", "apt_group", "apt")),
    ("MALWARE", ("malware", "trojan", "ransomware", "backdoor", "payload_name", "malware_family")),
    ("VULNERABILITY", ("vulnerability", "cve", "exploit", "weakness")),
    ("INDICATOR", ("indicator", "ioc", "ip_address", "ipaddress", "src_ip", "dst_ip", "domain_name", "file_hash", "hash_value", "malicious_url", "c2_server", "c2_domain")),
    ("MILITARY_UNIT", ("military_unit", "battalion", "brigade", "regiment", "squadron", "task_force")),
    ("WEAPON", ("weapon", "missile_system", "missile", "warhead", "aircraft_type")),
    ("OPERATION", ("operation_name", "codename", "campaign_name")),
    ("FACILITY", ("military_base", "air_base", "naval_base", "installation", "data_center", "datacenter", "facility")),
    ("ORGANIZATION", ("company", "organization", "org", "employer", "vendor", "publisher", "manufacturer", "supplier", "industry", "sector")),
    ("PERSON", ("author", "customer", "client", "contact", "employee", "owner", "manager", "assignee", "user", "person", "buyer", "seller", "recipient", "sender", "requester", "reviewer", "approver")),
    ("LOCATION", ("city", "country", "address", "location", "state", "region")),
    ("PRODUCT", ("product", "item", "sku")),
    ("CONCEPT", ("attack_type", "attacktype", "tactic", "technique", "classification", "attack_method")),
    ("EVENT", ("event", "incident")),
    ("LAW", ("law", "regulation", "policy", "sanction", "treaty")),
    ("DATE", ("date", "timestamp", "occurred_at", "discovered_date", "published_date", "reported_date", "detected_at", "year")),
    ("PERSON", ("name", "title")),
)
LONGEST_VALUE = 100
DEEPEST_LEVEL = 6
