"""Diagrams and model output to rows.

Each function reads one text; `operators.parsing` applies them in Arrow batches.
The flowchart reader is a scanner over statements, so chained edges and joined
targets come out whole (Q-08); compat=True reads only the first edge of a chain
and the first of joined targets.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

#: Node shapes, longest first; braces make a condition.
SHAPES = (("{{", "}}"), ("{", "}"), ("[", "]"))
IDENT = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
SOLID, DOTTED = "-->", "-.->"
LINK = re.compile(
    r"\s*(?:(?P<arrow>-->|-\.->)\s*(?:\|(?P<bar>[^|]*)\|)?"
    r"|--\s*(?P<solid>[^->\s][^->]*?)\s*-->|-\.\s*(?P<dotted>[^.>\s][^.>]*?)\s*\.->)\s*"
)
HEADER = re.compile(r"(?:flowchart|graph)(?:\s+(?:TB|TD|BT|RL|LR)\b.*)?;?$", re.I)
CHINESE = re.compile("[一-鿿]")
ARROWS = {"->>": "sync", "-->>": "async", "->": "async", "-->": "async"}
MESSAGE = re.compile(r"(\w+)\s*(-->>|->>|-->|->)\s*(\w+)\s*:\s*(.+)$")
PARTICIPANT = re.compile(r"participant\s+(\w+)(?:\s+as\s+(.+))?$", re.I)
BLOCK_WORDS = {"alt", "else", "end", "loop", "opt", "par", "and"}  # fixed


@dataclass
class Diagram:
    nodes: dict[str, tuple[str, str]] = field(default_factory=dict)  # id: (text, type)
    edges: list[tuple[str, str, str, str]] = field(default_factory=list)  # source, target, label, style


def _node(line: str, at: int, out: Diagram) -> tuple[str | None, int]:
    m = IDENT.match(line, at)
    if not m:
        return None, at
    name, at = m.group(), m.end()
    rest = at + len(line[at:]) - len(line[at:].lstrip())
    for left, right in SHAPES:
        if line.startswith(left, rest):
            end = line.find(right, rest + len(left))
            if end >= 0:
                text = line[rest + len(left) : end].strip()
                text = text[1:-1] if len(text) > 1 and text[0] == text[-1] == '"' else text
                out.nodes[name] = (text.strip(), "condition" if left[0] == "{" else "event")
                return name, end + len(right)
    return name, at


def _group(line: str, at: int, out: Diagram) -> tuple[list[str], int]:
    """Nodes joined by &."""
    names: list[str] = []
    while True:
        while at < len(line) and line[at].isspace():
            at += 1
        name, at = _node(line, at, out)
        if name is None:
            return names, at
        names.append(name)
        gap = re.match(r"\s*&", line[at:])
        if not gap:
            return names, at
        at += gap.end()


def flowchart(code: str | None, chinese_only: bool = False, compat: bool = False) -> Diagram:
    """M3, M4: nodes and edges.  An id without definition is a node of its own
    name; with chinese_only only nodes with Chinese text and edges between such
    are kept.  A header line is one that names nothing but a direction (Q-25)."""
    out = Diagram()
    seen: set[tuple[str, str, str]] = set()
    found: list[tuple[str, str, str, str]] = []
    for line in (code or "").strip().split("\n"):
        line = line.strip().rstrip(";")
        if not line or line.startswith("%%") or HEADER.match(line):
            continue
        sources, at = _group(line, 0, out)
        while sources:
            m = LINK.match(line, at)
            if not m:
                break
            targets, end = _group(line, m.end(), out)
            if not targets:
                break
            style = m["arrow"] or (DOTTED if m["dotted"] else SOLID)
            label = (m["bar"] or m["solid"] or m["dotted"] or "").strip()
            label = re.sub(r"\[[^\]]*\]|\{[^}]*\}", "", label).strip()
            for t in targets[:1] if compat else targets:
                for s in sources:
                    if (s, t, label) not in seen:
                        seen.add((s, t, label))
                        found.append((s, t, label, style))
            if compat:
                break
            sources, at = targets, end
    if chinese_only:
        out.nodes = {k: v for k, v in out.nodes.items() if CHINESE.search(v[0])}
        out.edges = [e for e in found if e[0] in out.nodes and e[1] in out.nodes]
        return out
    for s, t, _, _ in found:
        out.nodes.setdefault(s, (s, "event"))
        out.nodes.setdefault(t, (t, "event"))
    out.edges = found
    return out


def sequence(code: str | None) -> tuple[dict[str, str], list[tuple[str, str, str, str]]]:
    """M5: participants (id: alias) and messages (sender, receiver, text, type) in order."""
    people: dict[str, str] = {}
    messages = []
    for line in (code or "").strip().split("\n"):
        line = line.strip()
        low = line.lower()
        if not line or low.startswith("sequencediagram") or line.startswith("%%") or low in BLOCK_WORDS:
            continue
        if m := PARTICIPANT.match(line):
            people[m[1]] = (m[2] or m[1]).strip()
        elif m := MESSAGE.match(line):
            for p in (m[1], m[3]):
                people.setdefault(p, p)
            messages.append((m[1], m[3], m[4].strip(), ARROWS[m[2]]))
    return people, messages


def graph_of(flow: str | None, seq: str | None, source_tg: str, chinese_only: bool = True) -> tuple[list[tuple], list[tuple]]:
    """M6-M8: nodes (name, node_type, properties, source_tg) and edges (src, dst,
    edge_type, relation_name) keyed by text.  Dotted edges trigger, others cause;
    a sequence message follows the one before, a repeated one adds no edge (Q-17)."""
    nodes: dict[str, tuple] = {}
    edges: dict[tuple[str, str], tuple] = {}
    d = flowchart(flow, chinese_only)
    for i, (text, kind) in d.nodes.items():
        nodes[text or i] = (text or i, kind, {"mermaid_id": i, "mermaid_type": kind}, [source_tg] if source_tg else [])
    for s, t, label, style in d.edges:
        a, b = (d.nodes[x][0] or x for x in (s, t))
        edges.setdefault((a, b), (a, b, "triggers" if style == DOTTED else "causal", label))
    people, messages = sequence(seq)
    last = None
    for n, (s, r, text, kind) in enumerate(messages):
        name = f"{people[s]} -> {people[r]}: {text}"
        if name not in nodes:
            props = {"sender": people[s], "receiver": people[r], "message": text, "message_type": kind, "order": str(n)}
            nodes[name] = (name, "event", props, [source_tg] if source_tg else [])
            if last is not None:
                edges.setdefault((last, name), (last, name, "causal", ""))
        last = name
    return list(nodes.values()), list(edges.values())


FENCE = re.compile(r"```[ \t]*([A-Za-z]*)\s*(.*?)```", re.S)
STOP_LINES = ("分析", "总结")  # fixed: headings after which a diagram has ended


def _kind(code: str) -> str | None:
    low = code.strip().lower()
    if low.startswith(("flowchart", "graph")):
        return "flowchart"
    return "sequence" if low.startswith("sequencediagram") or "->>" in code else None


def diagrams(content: str | None) -> dict[str, str]:
    """M1, M2: the first flowchart and sequence in model output: fenced blocks,
    else lines after a header, else single backticks."""
    out: dict[str, str] = {}
    content = content or ""
    for m in FENCE.finditer(content):
        if kind := _kind(m[2]):
            out.setdefault(kind, m[2].strip())
    if out:
        return out
    kind, held = None, []
    for line in [*content.split("\n"), "\0end"]:
        bare = line.strip()
        low = bare.lower()
        head = "flowchart" if low.startswith(("flowchart", "graph ")) else "sequence" if low.startswith("sequencediagram") else None
        if head or bare.startswith(STOP_LINES) or line == "\0end":
            if kind and held:
                out.setdefault(kind, "\n".join(held))
            kind, held = head, [line] if head else []
        elif kind and bare and not bare.startswith("#"):
            held.append(line)
    if out:
        return out
    for code in re.findall(r"`([^`]+)`", content):
        if (k := _kind(code)) and not out:
            out[k] = code.strip()
    return out


def balanced(content: str) -> list[str]:
    """Every outermost {...} of a text whose braces balance, from each opening one."""
    out, stack = [], []
    for i, c in enumerate(content):
        if c == "{":
            stack.append(i)
        elif c == "}" and stack:
            start = stack.pop()
            out.append((start, content[start : i + 1]))
    return [t for _, t in sorted(out)]


def json_of(content: str | None):
    """the first JSON value: fenced, the whole text, or balanced braces."""
    content = content or ""
    tries = [m[2] for m in FENCE.finditer(content)] + [content] + balanced(content)
    for t in tries:
        try:
            return json.loads(t.strip())
        except ValueError:
            continue
    return None


def repaired(text: str) -> str:
    """without trailing commas, trailing quotes and anything after the last brace."""
    text = re.sub(r",\s*([}\]])", r"\1", text).rstrip("'\"` \n\r\t")
    return text if text.endswith("}") else text[: text.rfind("}") + 1] or text


def _first(d: dict, *keys, default=""):
    return next((d[k] for k in keys if k in d), default)


def graph_of_json(content: str | None, source_tg: str = "", default_relation: str = "导致") -> tuple[list[tuple], list[tuple]] | None:
    """Nodes and edges of model output, edges by name (Q-06); a thinking
    part is dropped, broken JSON is repaired.  None if there is no object."""
    text = re.sub(r"<think>.*?</think>", "", content or "", flags=re.S)
    start = text.find("{")
    fixed = repaired(text[start:]) if start >= 0 else ""
    data = None
    for t in [m[2] for m in FENCE.finditer(text)] + [text, fixed] + balanced(text):
        try:
            data = json.loads(t.strip())
        except ValueError:
            continue
        if isinstance(data, dict):
            break
    if not isinstance(data, dict):
        return None
    nodes, names = [], {}
    for n in _first(data, "entities", "nodes", default=[]):
        if isinstance(n, dict):
            key = _first(n, "id", "name")
            name = _first(n, "name", "text", default=key)
            if name:
                names[key] = name
                props = {k: v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for k, v in (n.get("properties") or {}).items()}
                nodes.append((name, str(_first(n, "type", "node_type", default="event")), props, [source_tg] if source_tg else []))
    edges = []
    for e in _first(data, "relations", "edges", default=[]):
        if isinstance(e, dict):
            a, b = names.get(_first(e, "source", "source_id", "from")), names.get(_first(e, "target", "target_id", "to"))
            if a and b:
                label = _first(e, "relation", "relation_name", "label", default=default_relation)
                edges.append((a, b, str(_first(e, "type", "edge_type", default="causal")), label))
    return nodes, edges


def keywords_and_code(content: str | None) -> tuple[list[str], str]:
    """Keywords and diagram of a model's JSON, also with the code in backticks."""
    content = content or ""
    if m := re.search(r'"mermaid_code"\s*:\s*`(.*?)`', content, re.S):
        words = re.search(r'"keywords"\s*:\s*(\[[^\]]*\])', content)
        try:
            kept = json.loads(words[1]) if words else []
        except ValueError:
            kept = []
        if m[1].strip():
            return kept, m[1].strip()
    for t in [m[2] for m in FENCE.finditer(content)] + [content[content.find("{") : content.rfind("}") + 1]]:
        try:
            data = json.loads(t.strip())
        except ValueError:
            continue
        if isinstance(data, dict) and data.get("mermaid_code"):
            return data.get("keywords") or [], data["mermaid_code"]
    return [], ""


#: Question categories of generated pairs and their types.
CATEGORIES = {"Cat_1_All_Pass": "factual", "Cat_2_Graph_Better": "procedural", "Cat_3_Only_Ours": "structural"}


def qa_of(response: str | None, source_doc: str) -> list[dict]:
    """Question and answer rows of a generator's JSON array."""
    response = response or ""
    try:
        items = json.loads(response[response.find("[") : response.rfind("]") + 1])
    except ValueError:
        return []
    rows = []
    for i, x in enumerate(items if isinstance(items, list) else [], 1):
        if not isinstance(x, dict):
            continue
        category = x.get("category", "")
        kind = CATEGORIES.get(category, x.get("question_type", "unknown"))
        note = x.get("analysis", "")
        reason, evidence = (note.get("reason", ""), note.get("evidence", "")) if isinstance(note, dict) else (str(note), "")
        rows.append(
            {
                "id": f"{source_doc}_{kind}_{i}", "question": x.get("question", ""), "answer": x.get("answer", ""),
                "question_type": kind, "difficulty": x.get("difficulty", "medium"), "source_doc": source_doc,
                "need_text_knowledge": category == "Cat_1_All_Pass", "related_nodes": x.get("related_nodes", []),
                "evidence": evidence, "analysis": reason,
                "graph1_can_answer": category in ("Cat_1_All_Pass", "Cat_2_Graph_Better"), "graph2_can_answer": True,
            }
        )
    return rows
