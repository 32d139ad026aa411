"""Built-in feature templates (PIP-7..9) and recipe generators (PIP-10..14).

Templates are data: step lists run by :func:`logweave.plans.chain.run_features`.
"""

from __future__ import annotations

from typing import Any


def _step(step_id: str, step_type: str, columns: list[str] | None = None, params: dict | None = None,
          output_mode: dict | None = None, selector: dict | None = None) -> dict[str, Any]:
    return {
        "step_id": step_id,
        "step_type": step_type,
        "enabled": True,
        "input_selector": selector or {"mode": "explicit", "columns": list(columns or [])},
        "params": dict(params or {}),
        "output_mode": {"mode": "append_new_columns", **(output_mode or {})},
    }


# The three built-in templates (ids, required/optional fields, steps).
BUILTIN_TEMPLATES: dict[str, dict[str, Any]] = {
    "nginx_access": {
        "id": "builtin:nginx_access",
        "log_type": "nginx_access",
        "required_columns": ["path", "status_code"],
        "optional_columns": ["event_time", "method", "user_agent", "bytes_sent", "request_duration"],
        "steps": [
            _step("nginx_path_features", "path_features", ["path"]),
            _step("nginx_status_category", "status_category", ["status_code"]),
            _step("nginx_method_encode", "category_encode", ["method"], output_mode={"suffix": "_code"}),
            _step("nginx_ua_length", "text_length", ["user_agent"], output_mode={"suffix": "_length"}),
            _step("nginx_path_entropy", "shannon_entropy", ["path"], output_mode={"suffix": "_entropy"}),
            _step("nginx_ua_complexity", "char_composition", ["user_agent"]),
            _step("nginx_admin_flag", "boolean_flag", ["path"], {"operator": "contains", "value": "admin"},
                  {"output_column": "path_has_admin"}),
            _step("nginx_bytes_bucket", "numeric_bucket", ["bytes_sent"], {"bins": 5}, {"suffix": "_bucket"}),
            _step("nginx_duration_bucket", "numeric_bucket", ["request_duration"], {"bins": 5},
                  {"suffix": "_bucket"}),
        ],
    },
    "program_runtime": {
        "id": "builtin:program_runtime",
        "log_type": "program_runtime",
        "required_columns": ["raw_message"],
        "optional_columns": ["severity", "host", "process_name", "event_time"],
        "steps": [
            _step("runtime_severity_map", "value_map", ["severity"],
                  {"mapping": {"low": 1, "medium": 2, "high": 3, "critical": 4, "error": 4, "warn": 2},
                   "default_value": 0}, {"suffix": "_score"}),
            _step("runtime_message_length", "text_length", ["raw_message"], output_mode={"suffix": "_length"}),
            _step("runtime_message_entropy", "shannon_entropy", ["raw_message"], output_mode={"suffix": "_entropy"}),
            _step("runtime_keyword_count", "keyword_count", ["raw_message"],
                  {"keywords": ["error", "exception", "failed", "timeout", "denied"]},
                  {"output_column": "raw_message_keyword_hits"}),
            _step("runtime_pattern_flags", "pattern_flags", ["raw_message"],
                  {"patterns": ["ip", "url", "hash", "base64_like", "email"]}),
            _step("runtime_host_frequency", "frequency_encode", ["host"], output_mode={"suffix": "_freq"}),
            _step("runtime_process_frequency", "frequency_encode", ["process_name"],
                  output_mode={"suffix": "_freq"}),
        ],
    },
    "nta_flow": {
        "id": "builtin:nta_flow",
        "log_type": "nta_flow",
        "required_columns": ["source_ip", "dest_ip"],
        "optional_columns": ["src_port", "dest_port", "protocol", "bytes", "duration", "host", "domain",
                             "source_host", "dest_host"],
        "steps": [
            _step("nta_source_ip", "ip_features", ["source_ip", "dest_ip"]),
            _step("nta_port_features", "port_features", ["src_port", "dest_port"]),
            _step("nta_protocol_map", "value_map", ["protocol"],
                  {"mapping": {"tcp": 1, "udp": 2, "icmp": 3}, "default_value": 0}, {"suffix": "_code"}),
            _step("nta_domain_entropy", "shannon_entropy", selector={"mode": "role_tag", "role_tag": "domain"},
                  output_mode={"suffix": "_entropy"}),
            _step("nta_bytes_bucket", "numeric_bucket", ["bytes"], {"bins": 5}, {"suffix": "_bucket"}),
            _step("nta_duration_bucket", "numeric_bucket", ["duration"], {"bins": 5}, {"suffix": "_bucket"}),
            _step("nta_flow_pair_count", "group_frequency", ["source_ip", "dest_ip"],
                  output_mode={"output_column": "flow_pair_count"}),
        ],
    },
}


def template_steps(template_id: str) -> list[dict[str, Any]]:
    key = template_id.split(":", 1)[-1]
    return [dict(s) for s in BUILTIN_TEMPLATES[key]["steps"]]


# Default output suffixes used by generated steps.
DEFAULT_SUFFIX = {
    "text_length": "_length", "byte_length": "_bytes", "token_count": "_tokens", "shannon_entropy": "_entropy",
    "keyword_count": "_keyword_hits", "frequency_encode": "_freq", "numeric_bucket": "_bucket",
    "numeric_scale": "_scaled", "group_frequency": "_group_count", "group_unique_count": "_unique_count",
    "group_duration": "_duration_seconds", "group_event_order": "_event_order",
    "time_since_previous_event": "_seconds_since_previous", "time_until_next_event": "_seconds_until_next",
    "group_value_change_flag": "_value_changed",
}


def _task(step_type: str, columns: list[str], params: dict | None = None,
          output_column: str | None = None) -> dict[str, Any]:
    om: dict[str, Any] = {}
    if step_type in DEFAULT_SUFFIX:
        om["suffix"] = DEFAULT_SUFFIX[step_type]
    if output_column:
        om["output_column"] = output_column
    return _step(f"{step_type}_{'_'.join(columns)}", step_type, columns, params, om)


# The behaviour recipes.  Each entry: recipe, step type, output name, parameters; {g} is the group key, {t} the first
# target column, and an entry that names a target applies only where there is one.
BEHAVIOR_RECIPES: list[tuple[str, str, str, tuple[str, ...]]] = [
    ("base", "group_frequency", "{g}_event_count", ()),
    ("base", "group_duration", "{g}_duration_seconds", ("time_column",)),
    ("base", "group_unique_count", "{g}_{t}_unique_count", ("time_column", "target_column")),
    ("window", "time_window_count", "{g}_15m_count", ("time_column", "window_minutes")),
    ("window", "window_spike_flag", "{g}_15m_spike", ("time_column", "window_minutes", "threshold")),
    ("window", "window_target_unique_count", "{g}_{t}_15m_unique_count", ("time_column", "target_column", "window_minutes")),
    ("sequence", "group_event_order", "{g}_event_order", ("time_column",)),
    ("sequence", "time_since_previous_event", "{g}_seconds_since_previous", ("time_column",)),
    ("sequence", "time_until_next_event", "{g}_seconds_until_next", ("time_column",)),
    ("sequence", "group_value_change_flag", "{g}_{t}_changed", ("time_column", "target_column")),
    ("flow", "window_status_change_count", "{g}_{t}_15m_change_count", ("time_column", "target_column", "window_minutes"))]
SPIKE_THRESHOLDS = {"entity": 10}


def behavior_tracking_steps(group_key: str, time_column: str, target_columns: list[str],
                            recipe_kinds: set[str], tracking_type: str, available: list[str]) -> list[dict]:
    """PIP-10: the entries of ``BEHAVIOR_RECIPES`` that the asked recipes and the known columns allow."""
    if not {group_key, time_column} <= set(available):
        return []
    target = next((c for c in target_columns if c in available and c not in (group_key, time_column)), None)
    asked = set(recipe_kinds) | ({"flow"} if tracking_type == "flow" and {"window", "sequence"} & set(recipe_kinds) else set())
    values = {"time_column": time_column, "target_column": target, "window_minutes": 15,
              "threshold": SPIKE_THRESHOLDS.get(tracking_type, 6)}
    return [_task(step, [group_key], {n: values[n] for n in names}, output.format(g=group_key, t=target))
            for recipe, step, output, names in BEHAVIOR_RECIPES
            if recipe in asked and (target is not None or "target_column" not in names)]


# The quick tasks.  Each entry: step type, where its input comes from, params, what must be known.
_MINUTES = {"window_minutes": 15}
QUICK_TASKS: dict[str, list[tuple[str, str, dict, tuple[str, ...]]]] = {
    "text_complexity": [
        ("text_length", "targets", {}, ()), ("byte_length", "targets", {}, ()), ("token_count", "targets", {}, ()),
        ("shannon_entropy", "targets", {}, ()),
        ("keyword_count", "targets", {"keywords": ["error", "failed", "timeout", "exception", "denied"]}, ()),
        ("pattern_flags", "targets", {}, ())],
    "high_cardinality": [
        ("frequency_encode", "targets", {}, ()),
        ("time_window_count", "first target", {"time_column": "$time", **_MINUTES}, ("time",)),
        ("window_spike_flag", "first target", {"time_column": "$time", **_MINUTES, "threshold": 10}, ("time",)),
        ("window_target_unique_count", "first target", {"time_column": "$time", "target_column": "$group", **_MINUTES},
         ("time", "group"))],
    "time_behavior": [
        ("derive_time_parts", "time or target", {}, ()),
        ("time_window_count", "first group", {"time_column": "$time or target", **_MINUTES}, ("group",)),
        ("window_spike_flag", "first group", {"time_column": "$time or target", **_MINUTES, "threshold": 10}, ("group",))],
    "numeric_statistics": [
        ("numeric_bucket", "targets", {"bins": 5}, ()), ("numeric_scale", "targets", {"method": "zscore"}, ())],
}


def quick_task_steps(strategy: str, target_columns: list[str], available: list[str],
                     group_columns: list[str] | None = None, time_column: str | None = None) -> list[dict]:
    """PIP-11..14: the steps of a quick task whose columns the table has; ``$`` params are filled in."""
    targets = [c for c in target_columns if c in available]
    if not targets:
        return []
    group = next((c for c in group_columns or [] if c in available), None)
    time = time_column if time_column in available else None
    inputs = {"targets": targets, "first target": targets[:1], "first group": [group], "time or target": [time or targets[0]]}
    values = {"$time": time, "$group": group, "$time or target": time or targets[0]}
    known = {k for k, v in (("time", time), ("group", group)) if v}
    return [_task(kind, list(inputs[source]), {k: values.get(v, v) if isinstance(v, str) else v for k, v in params.items()})
            for kind, source, params, needs in QUICK_TASKS.get(strategy, []) if known.issuperset(needs)]


def recommend_template(columns: list[str], log_type: str | None = None) -> str | None:
    """PRF-15: template id from the parser profile or the available columns."""
    cols = set(columns)
    if log_type == "nginx_access" or {"path", "status_code"} <= cols:
        return "builtin:nginx_access"
    if {"source_ip", "dest_ip"} <= cols:
        return "builtin:nta_flow"
    if "raw_message" in cols or log_type in ("generic_log", "program_runtime"):
        return "builtin:program_runtime"
    return None
