"""DuckDB texts for the queries, written from the rules and not from the operators."""

from __future__ import annotations

from flowsentry import dims
from flowsentry.fixtures import with_views

ORACLES = {}


def ports(values) -> str:
    return ", ".join(str(v) for v in values)


def texts(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def case(key: str, table: dict, default: str = "null") -> str:
    def lit(v):
        return str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"

    return f"case {key} " + " ".join(f"when {lit(k)} then {lit(v)}" for k, v in table.items()) + f" else {default} end"


# ---- packets and flows ------------------------------------------------------------------
PACKETS = with_views("fx_packets")

ORACLES["packet_normalize"] = f"""
with {PACKETS}
select seq, ts_us, src_ip, dst_ip, protocol, length, 64 ttl,
  cast(src_port as int) src_port, cast(dst_port as int) dst_port, flags,
  case when protocol = 6 then seq else 0 end tcp_seq, case when protocol = 6 then seq + 1 else 0 end tcp_ack,
  case when protocol = 1 then 8 end icmp_type, case when protocol = 1 then 0 end icmp_code
from fx_packets
"""


def flow_ctes(cap: int = 1000) -> str:
    return f"""{PACKETS},
pk as (
  select *, (src_ip, src_port) <= (dst_ip, dst_port) low,
    case when (src_ip, src_port) <= (dst_ip, dst_port) then src_ip || '|' || src_port || '|' || dst_ip || '|' || dst_port
      else dst_ip || '|' || dst_port || '|' || src_ip || '|' || src_port end || '|' || protocol ck
  from fx_packets),
gaps as (
  select *, lag(ts_us) over w pt, lag(flags) over w pf from pk window w as (partition by ck order by ts_us, seq)),
segs as (
  select *, sum(case when pt is null or regexp_matches(pf, '[FR]') or ts_us - pt > 60000000 then 1 else 0 end)
    over (partition by ck order by ts_us, seq rows unbounded preceding) seg from gaps),
parts as (
  select *, (row_number() over (partition by ck, seg order by ts_us, seq) - 1) // {cap} part from segs),
firsts as (
  select *, first_value(low) over w fl, first_value(seq) over w fseq,
    first_value(src_ip) over w s_ip, first_value(dst_ip) over w d_ip,
    first_value(src_port) over w s_p, first_value(dst_port) over w d_p
  from parts window w as (partition by ck, seg, part order by ts_us, seq rows between unbounded preceding and unbounded following)),
agg as (
  select fseq flow_id, s_ip src_ip, d_ip dst_ip, cast(s_p as int) src_port, cast(d_p as int) dst_port, protocol,
    min(ts_us) start_us, max(ts_us) end_us,
    count(*) filter (low = fl) fwd_packets, count(*) filter (low <> fl) bwd_packets, count(*) total_packets,
    cast(coalesce(sum(length) filter (low = fl), 0) as bigint) fwd_bytes,
    cast(coalesce(sum(length) filter (low <> fl), 0) as bigint) bwd_bytes,
    cast(sum(length) as bigint) total_bytes,
    bool_or(contains(flags, 'A')) a, bool_or(contains(flags, 'S')) has_syn,
    bool_or(contains(flags, 'F')) has_fin, bool_or(contains(flags, 'R')) has_rst
  from firsts group by ck, seg, part, fseq, s_ip, d_ip, s_p, d_p, protocol),
flows_raw as (
  select flow_id, src_ip, dst_ip, src_port, dst_port, protocol, start_us, end_us,
    greatest((end_us - start_us) / 1000.0, 0.001) duration_ms, fwd_packets, bwd_packets, total_packets,
    fwd_bytes, bwd_bytes, total_bytes,
    case when a then 'A' else '' end || case when has_fin then 'F' else '' end || case when has_rst then 'R' else '' end
      || case when has_syn then 'S' else '' end flags, has_syn, has_fin, has_rst,
    case when has_fin or has_rst then 'fin_rst' when total_packets >= {cap} then 'cap'
      when (select max(ts_us) from fx_packets) - end_us > 60000000 then 'idle' else 'open' end close_reason
  from agg),
fl as (
  select *, total_bytes / (duration_ms / 1000 + 1e-9) byte_rate, total_packets / (duration_ms / 1000 + 1e-9) pkt_rate
  from flows_raw)"""


for _name, _cap in (("flows", 1000), ("flows_cap5", 5)):
    ORACLES[_name] = f"""
with {flow_ctes(_cap)}
select * replace (round(duration_ms, 3) as duration_ms, round(byte_rate, 3) as byte_rate, round(pkt_rate, 3) as pkt_rate)
from fl
"""

ORACLES["uni_flows"] = f"""
with {PACKETS}
select src_ip, dst_ip, cast(src_port as int) src_port, cast(dst_port as int) dst_port, protocol, count(*) pkts,
  cast(sum(length) as bigint) bytes, count(*) filter (protocol = 6 and contains(flags, 'S')) syns,
  min(ts_us) start_us, max(ts_us) end_us
from fx_packets group by all
"""

FEATURES = """
features as (
  select flow_id, duration_ms, total_packets, total_bytes, fwd_packets, bwd_packets, fwd_bytes, bwd_bytes,
    greatest(pkt_rate, 0.001) pkt_rate, greatest(byte_rate, 0.001) byte_rate,
    fwd_packets / greatest(bwd_packets, 1) fwd_bwd_ratio, total_bytes / total_packets avg_pkt_size,
    cast(has_syn as int) has_syn, cast(has_fin as int) has_fin, cast(has_rst as int) has_rst,
    cast(dst_port < 1024 as int) dst_port_well_known,
    cast(dst_port >= 1024 and dst_port < 49152 as int) dst_port_registered,
    cast(dst_port >= 49152 as int) dst_port_ephemeral, cast(src_port < 1024 as int) src_port_privileged,
    cast(protocol = 6 as int) is_tcp, cast(protocol = 17 as int) is_udp, cast(protocol = 1 as int) is_icmp,
    ln(1 + total_bytes) log_total_bytes, ln(1 + greatest(pkt_rate, 0.001)) log_pkt_rate,
    ln(1 + greatest(byte_rate, 0.001)) log_byte_rate
  from fl)"""

ORACLES["flow_features"] = f"""
with {flow_ctes()}, {FEATURES}
select flow_id, {", ".join(f"round(cast(cast({c} as float) as double), 1) {c}" for c in dims.FEATURES)} from features
"""

# ---- signatures ------------------------------------------------------------------------------
SIG_COLUMNS = (
    "flow_id, start_us, rule_name, severity, description, mitre_tactic, mitre_technique, src_ip, dst_ip, src_port, dst_port"
)
_SIG = {name: (severity, tactic, technique) for name, severity, tactic, technique in dims.SIGNATURES}

RATES = """
rates as (
  select *,
    count(*) filter (has_syn) over s n_syn,
    count(*) filter (protocol = 1) over s n_icmp
  from fl
  window s as (partition by src_ip order by cast(start_us as hugeint) * 10000000 + flow_id
    range between cast(1000000 as hugeint) * 10000000 + 9999999 preceding and current row)),
seen as (
  select a.flow_id, count(distinct b.dst_port) n_ports
  from fl a join fl b on a.src_ip = b.src_ip and b.start_us between a.start_us - 10000000 and a.start_us
    and (b.start_us, b.flow_id) <= (a.start_us, a.flow_id)
  group by a.flow_id),
rated as (select r.*, n_ports from rates r join seen using (flow_id))"""


def rule_sql(name: str, where: str, description: str, table: str = "fl") -> str:
    severity, tactic, technique = _SIG[name]
    zero = name == "ICMP_FLOOD"
    return f"""select flow_id, start_us, '{name}' rule_name, '{severity}' severity, {description} description,
  '{tactic}' mitre_tactic, '{technique}' mitre_technique, src_ip, dst_ip,
  {'0' if zero else 'src_port'} src_port, {'0' if zero else 'dst_port'} dst_port
from {table} where {where}"""


def rules(icmp: int = 200, table: str = "rated") -> dict[str, str]:
    return {
        "KNOWN_MALICIOUS_PORT": rule_sql(
            "KNOWN_MALICIOUS_PORT", f"dst_port in ({ports(dims.FLOW_BAD_PORTS)})",
            "'Connection to known malicious/C2 port ' || dst_port", table),
        "PORT_SCAN": rule_sql(
            "PORT_SCAN", "n_ports >= 20", "src_ip || ' scanned ' || n_ports || ' unique ports in 10s'", "rated"),
        "SYN_FLOOD": rule_sql(
            "SYN_FLOOD", "has_syn and n_syn >= 100", "'SYN flood from ' || src_ip || ': ' || n_syn || ' SYNs/sec'", "rated"),
        "ICMP_FLOOD": rule_sql(
            "ICMP_FLOOD", f"protocol = 1 and n_icmp >= {icmp}",
            "'ICMP flood from ' || src_ip || ': ' || n_icmp || ' packets/sec'", "rated"),
        "DNS_AMPLIFICATION": rule_sql(
            "DNS_AMPLIFICATION",
            "protocol = 17 and (src_port = 53 or dst_port = 53) and bwd_bytes > 4000 and bwd_bytes / greatest(fwd_bytes, 1) > 10",
            "'Possible DNS amplification: ' || fwd_bytes || 'B req → ' || bwd_bytes || 'B resp'", table),
        "SENSITIVE_PORT_ACCESS": rule_sql(
            "SENSITIVE_PORT_ACCESS", f"dst_port in ({ports(dims.FLOW_SENSITIVE_PORTS)})",
            "'Access to sensitive service port ' || dst_port", table),
    }


for _name, _rule in (
    ("sig_malicious_port", "KNOWN_MALICIOUS_PORT"),
    ("sig_sensitive_port", "SENSITIVE_PORT_ACCESS"),
    ("sig_dns_amplification", "DNS_AMPLIFICATION"),
):
    ORACLES[_name] = f"with {flow_ctes()} {rules(table='fl')[_rule]}"
for _name, _rule in (("sig_port_scan", "PORT_SCAN"), ("sig_syn_flood", "SYN_FLOOD"), ("sig_icmp_flood", "ICMP_FLOOD")):
    ORACLES[_name] = f"with {flow_ctes()}, {RATES} {rules(icmp=15)[_rule]}"

SIGNATURE_ALERTS = f"""{flow_ctes()}, {RATES},
candidates as ({" union all ".join(f"select {i} ord, * from ({q})" for i, q in enumerate(rules().values()))}),
picked as (
  select * from candidates
  qualify row_number() over (partition by flow_id order by {case("severity", dims.SEVERITY_RANK)} desc, ord) = 1),
sig_alerts as (
  select flow_id source_id, start_us ts_us, 'NETWORK' alert_type, severity, src_ip, dst_ip, src_port, dst_port,
    'TCP' protocol, description, mitre_tactic, mitre_technique, cast(1.0 as double) confidence, 0 model_votes,
    '{{}}' raw_features
  from picked)"""
ORACLES["signature_alerts"] = f"with {SIGNATURE_ALERTS} select * from sig_alerts"

HITS = f"""{PACKETS},
hits as (
  select ts_us, seq, src_ip, dst_ip, cast(dst_port as int) dst_port, rule, severity, technique, description,
    {case("protocol", dims.PROTOCOLS, "cast(protocol as varchar)")} protocol
  from (
    select *,
      case when bad then 'MALICIOUS_PORT' when soft then 'SENSITIVE_ACCESS' when dns then 'DNS_AMPLIFICATION' end rule,
      case when bad then 'CRITICAL' else 'HIGH' end severity,
      case when bad then 'T1071' when soft then 'T1190' else 'T1498.002' end technique,
      case when bad then 'C2 port ' || dst_port || ' — ' || bad_name
        when soft then soft_name || ' access attempt (port ' || dst_port || ')'
        else 'DNS amplification — ' || length || 'B response' end description
    from (
      select *, {case("dst_port", dims.CAPTURE_BAD_PORTS)} bad_name, bad_name is not null bad,
        {case("dst_port", dims.CAPTURE_SENSITIVE_PORTS)} soft_name, soft_name is not null soft,
        protocol = 17 and (dst_port = 53 or src_port = 53) and length > 2000 dns
      from fx_packets))
  where rule is not null),
scans as (
  select cast(null as bigint) ts_us, cast(null as bigint) seq, src_ip, cast(null as varchar) dst_ip, 0 dst_port,
    'PORT_SCAN' rule, 'HIGH' severity, 'T1046' technique,
    'Port scan — ' || count(distinct dst_port) || ' unique ports probed' description, 'TCP' protocol
  from fx_packets group by src_ip having count(distinct dst_port) > 20),
floods as (
  select cast(null as bigint) ts_us, cast(null as bigint) seq, src_ip, cast(null as varchar) dst_ip, 80 dst_port,
    'SYN_FLOOD' rule, 'CRITICAL' severity, 'T1499' technique,
    'SYN flood — ' || count(*) || ' SYN packets' description, 'TCP' protocol
  from fx_packets where protocol = 6 and contains(flags, 'S') group by src_ip having count(*) > 80),
every as (select * from hits union all select * from scans union all select * from floods)"""


def profiles(source: str) -> str:
    return f"""
profiles as (
  select src_ip, count(*) hits,
    arg_max(severity, {case("severity", dims.SEVERITY_RANK)}) severity,
    array_to_string(list_sort(list(distinct rule)), ' · ') rules,
    array_to_string(list_transform(list_sort(coalesce(list(distinct dst_port) filter (dst_port > 0), [])), lambda x: cast(x as varchar)), ', ') ports,
    array_to_string(list_sort(list(distinct technique)), ' · ') techniques,
    first(description order by case rule when 'PORT_SCAN' then stage1 when 'SYN_FLOOD' then stage2 else 0 end,
      ts_us nulls first, seq nulls first, description) description,
    count(distinct dst_ip) n_targets,
    array_to_string(list_slice(list_sort(coalesce(list(distinct dst_ip) filter (dst_ip is not null), [])), 1, 4), ', ') targets
  from (select *, 1 stage1, 2 stage2 from {source}) group by src_ip)"""


ORACLES["attacking_sources"] = f"""
with {SIGNATURE_ALERTS},
marks as (select start_us ts_us, flow_id seq, src_ip, dst_ip, dst_port, rule_name rule, severity,
  mitre_technique technique, description from picked), {profiles("marks")}
select * from profiles
"""
ORACLES["packet_rules"] = f"with {HITS} select * from hits"
ORACLES["capture_port_scan"] = f"with {HITS} select * from scans"
ORACLES["capture_syn_flood"] = f"with {HITS} select * from floods"
ORACLES["all_hits"] = f"with {HITS} select * from every"
ORACLES["attacker_profiles"] = f"with {HITS}, {profiles('every')} select * from profiles"
ORACLES["attacker_targets"] = (
    f"with {HITS} select src_ip, dst_ip, count(*) hits from every where dst_ip is not null group by all"
)
ORACLES["protocol_counts"] = f"""
with {PACKETS}
select protocol, {case("protocol", dims.PROTOCOLS, "'Proto ' || protocol")} name, count(*) packets
from fx_packets group by protocol
"""
ORACLES["packet_timeline"] = f"""
with {PACKETS}
select strftime(make_timestamp(ts_us), '%Y-%m-%d %H:%M') "minute", count(*) packets from fx_packets group by 1
"""
ORACLES["capture_kpis"] = f"""
with {HITS}
select count(*) packets, count(distinct (src_ip, dst_ip, src_port, dst_port, protocol)) flows,
  count(distinct src_ip) sources, count(distinct dst_ip) destinations, (max(ts_us) - min(ts_us)) / 1000000.0::double duration_s,
  (select count(*) from every) hits, (select count(distinct src_ip) from every) attackers
from fx_packets
"""
ORACLES["hit_breakdown"] = f"""
with {HITS}
select 'severity' kind, severity "name", count(*) hits from every group by severity
union all select 'rule', replace(rule, '_', ' '), count(*) from every group by rule
"""
SERVICES = {**dims.CAPTURE_BAD_PORTS, **dims.CAPTURE_SENSITIVE_PORTS}
ORACLES["top_ports"] = f"""
with {PACKETS}
select cast(dst_port as int) dst_port, count(*) n,
  ':' || dst_port || ' (' || {case("dst_port", SERVICES, "''")} || ')' "label"
from fx_packets where dst_port > 0 group by fx_packets.dst_port order by n desc, fx_packets.dst_port limit 10
"""
ORACLES["packet_preview"] = f"""
with {PACKETS}
select * exclude (role) replace (cast(src_port as int) as src_port, cast(dst_port as int) as dst_port),
  {case("protocol", dims.PROTOCOLS, "'Other'")} proto_name
from fx_packets order by seq limit 200
"""
_INTERNAL = r"regexp_matches({c}, '^(10\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.)')"
ORACLES["internal_traffic"] = f"""
with {PACKETS}
select {_INTERNAL.format(c='src_ip')} src_internal, {_INTERNAL.format(c='dst_ip')} dst_internal, count(*) packets,
  cast(sum(length) as bigint) bytes
from fx_packets group by 1, 2
"""

# ---- host log ------------------------------------------------------------------------------------
LOG = with_views("fx_log_lines")


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_AUTH = {name: dims.AUTH_HEADER + body for name, body, _, _ in dims.AUTH_RULES}


def auth_group(i: int, names=tuple(_AUTH)) -> str:
    return "case rule " + " ".join(f"when '{n}' then regexp_extract(text, {quoted(_AUTH[n])}, {i})" for n in names) + " end"


AUTH = f"""{LOG},
ruled as (
  select line_no, trim(line) text, case {" ".join(f"when regexp_matches(trim(line), {quoted(p)}) then '{n}'" for n, p in _AUTH.items())} end rule
  from fx_log_lines),
auth as (
  select line_no, epoch_us(strptime('2024 ' || regexp_replace({auth_group(1)}, '\\s+', ' ', 'g'), '%Y %b %d %H:%M:%S')) ts,
    {case("rule", {n: e for n, _, e, _ in dims.AUTH_RULES})} event_type, {auth_group(2)} hostname,
    regexp_replace({auth_group(4)}, ',$', '') "user", {auth_group(5, ("SSH_FAILED", "SSH_SUCCESS"))} source_ip,
    cast({auth_group(3)} as int) pid, {auth_group(5, ("SUDO_SUCCESS",))} command,
    rule || ': ' || substr(text, 1, 120) description, {case("rule", {n: s for n, _, _, s in dims.AUTH_RULES})} severity,
    text raw_line
  from ruled where rule is not null),
fails as (
  select line_no, count(*) over (partition by source_ip order by cast(ts as hugeint) * 100000000 + line_no
    range between cast(60000000 as hugeint) * 100000000 + 99999999 preceding and current row) n
  from auth where event_type = 'AUTH_FAIL'),
forced as (
  select * exclude (n) replace (
    case when n >= 5 then 'BRUTE_FORCE' else event_type end as event_type,
    case when n >= 5 then 'CRITICAL' else severity end as severity,
    case when n >= 5 then 'SSH brute force from ' || source_ip || ': ' || n || ' failures in 60s' else description end as description)
  from auth left join fails using (line_no))"""
ORACLES["auth_events"] = f"with {AUTH} select * from auth"
ORACLES["auth_brute_force"] = f"with {AUTH} select * from forced"

_UP = [(f"(?i){p}", *rest) for p, *rest in dims.UPLOAD_RULES]


def upload_group(position: int) -> str:
    whens = " ".join(
        f"when '{event}' then regexp_extract(line, {quoted(p)}, {groups[position]})" for p, event, _, *groups in _UP if groups[position]
    )
    return f"case type {whens} else '{dims.NO_VALUE}' end"


UPLOAD = f"""{LOG},
typed as (
  select line_no, line, case {" ".join(f"when regexp_matches(line, {quoted(p)}) then '{e}'" for p, e, *_ in _UP)} end type
  from fx_log_lines),
uploaded as (
  select line_no, type, {case("type", {r[1]: r[2] for r in _UP})} severity, {upload_group(0)} "user", {upload_group(1)} ip,
    regexp_extract(line, {quoted(dims.UPLOAD_TIME)}, 1) ts,
    regexp_extract(regexp_extract(line, {quoted(dims.UPLOAD_TIME)}, 1), {quoted(dims.UPLOAD_MINUTE)}, 1) "minute",
    substr(trim(line), 1, 100) raw
  from typed where type is not null),
summary as (
  select 'events' "section", type "key", count(*) n from uploaded group by type
  union all select 'fails_by_ip', ip, count(*) from uploaded where type = 'SSH_FAIL' group by ip
  union all select 'fails_by_user', "user", count(*) from uploaded where type = 'SSH_FAIL' group by "user"
  union all select 'users_by_ip', ip, count(distinct "user") from uploaded where type = 'SSH_SUCCESS' group by ip
  union all select 'sudo_by_user', "user", count(*) from uploaded where type = 'SUDO_EXEC' group by "user")"""
ORACLES["log_upload_events"] = f"with {UPLOAD} select * from uploaded"
ORACLES["log_summary"] = f"with {UPLOAD} select * from summary"
ORACLES["log_kpis"] = f"""
with {UPLOAD}
select cast(sum(n) filter ("section" = 'events') as bigint) events,
  count(*) filter ("section" = 'fails_by_ip' and n >= 5) brute_force_ips, count(*) filter ("section" = 'fails_by_ip') attacker_ips,
  count(*) filter ("section" = 'fails_by_user') targeted_users,
  cast(coalesce(sum(n) filter ("section" = 'sudo_by_user'), 0) as bigint) sudo_runs
from summary
"""
ORACLES["log_timeline"] = f"""with {UPLOAD} select "minute", count(*) events from uploaded where "minute" <> '' group by 1"""
ORACLES["brute_force_profiles"] = f"""
with {UPLOAD}
select ip, count(*) failures, case when count(*) > 50 then 'CRITICAL' when count(*) > 20 then 'HIGH' else 'MEDIUM' end severity,
  'SSH Brute Force' attack_type, 'T1110.001' mitre_technique, 'Credential Access' mitre_tactic
from uploaded where type = 'SSH_FAIL' group by ip having count(*) >= 5 order by failures desc, ip limit 10
"""
ORACLES["top_targeted_users"] = f"""
with {UPLOAD}
select "user", count(*) failures from uploaded where type = 'SSH_FAIL' group by 1 order by 2 desc, 1 limit 12
"""

# ---- files and processes -----------------------------------------------------------------------
FILES = f"""{with_views("fx_files")},
old as (select 'host0' host, path, sha256(old_body) sha256 from fx_files where in_old),
new as (select 'host0' host, path, sha256(new_body) sha256 from fx_files where in_new)"""
ORACLES["file_hash_snapshot"] = f"with {FILES} select * from old"
ORACLES["file_integrity_diff"] = f"""
with {FILES}
select host, kind event_type, path file_path, old_hash, new_hash,
  case when kind = 'DELETED' or kind = 'MODIFIED' and ({" or ".join(f"starts_with(path, '{p}')" for p in dims.CRITICAL_PATHS)})
    then 'HIGH' else 'MEDIUM' end severity, kind || ': ' || path description
from (
  select coalesce(o.host, n.host) host, coalesce(o.path, n.path) path, o.sha256 old_hash, n.sha256 new_hash,
    case when n.path is null then 'DELETED' when o.path is null then 'CREATED' when o.sha256 <> n.sha256 then 'MODIFIED' end kind
  from old o full join new n on o.path = n.path)
where kind is not null
"""
ORACLES["process_anomalies"] = f"""
with {with_views("fx_processes")},
fresh as (
  select c.*, coalesce(p.name, '') parent_name
  from fx_processes c left join fx_processes p on p.scan_no = c.scan_no and p.host = c.host and p.pid = c.ppid
  where not exists (select 1 from fx_processes b where b.scan_no = c.scan_no - 1 and b.host = c.host and b.pid = c.pid)
    and exists (select 1 from fx_processes b where b.scan_no = c.scan_no - 1 and b.host = c.host)),
checked as (
  select *, name in ({texts(dims.SUSPICIOUS_NAMES)}) c1, parent_name in ({texts(dims.WEB_PARENTS)}) and name in ({texts(dims.SHELLS)}) c2,
    name in ({texts(dims.SHELLS)}) and ({" or ".join(f"contains(cmdline, '{m}')" for m in dims.REVERSE_SHELL_MARKS)}) c3
  from fresh)
select scan_no, host, case when c1 then 'SUSPICIOUS_PROCESS' else 'SUSPICIOUS_SPAWN' end event_type, pid, name process_name,
  ppid parent_pid, parent_name, cmdline,
  case when c1 then 'Known suspicious tool: ' || name || ' (pid=' || pid || ')'
    when c2 then 'Shell ''' || name || ''' spawned by web process ''' || parent_name || ''' — possible RCE (pid=' || pid || ')'
    else 'Potential reverse shell: ' || substr(cmdline, 1, 80) end description, 'CRITICAL' severity
from checked where c1 or c2 or c3
"""

ORACLES["process_anomalies_gaps"] = ORACLES["process_anomalies"].replace("select scan_no, host", "select scan_no * 2 + scan_no // 3 scan_no, host")
ORACLES["file_integrity_multi_host"] = f"""
with one as ({ORACLES["file_integrity_diff"]})
select * from one union all select * replace ('host1' as host) from one
"""
ORACLES["dhcp_identity"] = f"""
with {with_views("fx_dhcp")},
given as (select u, min(seq) filter (yiaddr <> '00000000') got, min(seq) filter (src_ip <> '0.0.0.0') heard from fx_dhcp group by u),
placed as (
  select d.*, case when yiaddr <> '00000000' or src_ip = '0.0.0.0' and got is not null then '10.2.0.' || (10 + u)
    when src_ip <> '0.0.0.0' then src_ip when heard is not null then '10.2.0.1'
    else 'mac:' || upper(regexp_replace(mac, '(..)(..)(..)(..)(..)(..)', '\\1:\\2:\\3:\\4:\\5:\\6')) end host_ip
  from fx_dhcp d join given using (u))
select host_ip, any_value(case when yiaddr <> '00000000' then '10.2.0.' || (10 + u) end) ip,
  upper(regexp_replace(arg_min(mac, seq), '(..)(..)(..)(..)(..)(..)', '\\1:\\2:\\3:\\4:\\5:\\6')) mac, arg_min(hostname, seq) hostname
from placed group by host_ip
"""

# What each message says, told from the view; nothing is decoded here.
ORACLES["binary_identity"] = f"""
with {with_views("fx_names")},
said as (
  select host, seq, 'hostname' field, pc v, 'Hostname from NetBIOS NS query' method from fx_names where et = 'click'
  union all select host, seq, 'ip', host, 'Hostname from NetBIOS NS query' from fx_names where et = 'click'
  union all select host, seq, 'mac', '0A:00:00:00:00:01', 'Hostname from NetBIOS NS query' from fx_names where et = 'click'
  union all select host, seq, 'username', account, 'Username from Kerberos AS-REQ cname' from fx_names where et = 'view' and account <> 'krbtgt'
  union all select host, seq, 'username', login, 'Username from NTLM AUTHENTICATE msg' from fx_names where et = 'purchase'
  union all select host, seq, 'hostname', case when long_form then pc else 'CORP' end,
    case when long_form then 'Hostname (workstation) from NTLM AUTHENTICATE' else 'Domain from NTLM AUTHENTICATE' end from fx_names where et = 'purchase'
  union all select host, seq, 'username', 'acct', 'Username from LDAP sAMAccountName' from fx_names where et in ('signup', 'error')
  union all select host, seq, 'fullname', case when full_name = 'R2D2' then 'Common Name' else full_name end,
    case when full_name = 'R2D2' then 'Full name from LDAP cn' else 'Full name from LDAP displayName' end from fx_names where et in ('signup', 'error')),
firsts as (select host, field, arg_min(v, seq) v, arg_min(method, seq) method, min(seq) seq from said group by host, field),
wide as (
  select host host_ip, any_value(v) filter (field = 'hostname') hostname, any_value(v) filter (field = 'username') username,
    any_value(v) filter (field = 'fullname') fullname, string_agg(method, '; ' order by seq, method) sources
  from firsts group by host)
select host_ip, hostname, username, coalesce(fullname, guess) fullname,
  sources || case when fullname is null and guess is not null then '; Full name inferred from username dot-notation pattern' else '' end sources
from (select *, case when regexp_full_match(username, '[A-Za-z]+[.][A-Za-z]+') then
  upper(username[1]) || lower(split_part(username, '.', 1)[2:]) || ' ' || upper(split_part(username, '.', 2)[1]) || lower(split_part(username, '.', 2)[2:]) || ' (inferred from account name)' end guess from wide)
"""

# ---- alerts ----------------------------------------------------------------------------------------
_TACTIC, _TECHNIQUE = case("event_type", dims.HOST_TACTICS, "'Unknown'"), case("event_type", dims.HOST_TECHNIQUES, "'Unknown'")
ALERTS = f"""{with_views("fx_alerts")},
alerts as (select *, {_TACTIC} mitre_tactic, {_TECHNIQUE} mitre_technique, ts_s * 1000000 ts_us from fx_alerts),
prints as (
  select *, md5(alert_type || '|' || coalesce(src_ip, '') || '|' || dst_ip || '|' || dst_port || '|' || substr(description, 1, 50)) fp
  from fx_alerts)"""
AS_OF_US = 1_700_003_600_000_000
ORACLES["alert_fingerprint"] = f"with {ALERTS} select id, fp fingerprint from prints"


def dedup_sql(source: str) -> str:
    """Jumps per fingerprint to the first time >= last kept + 60."""
    return f"""
jumps as (
  select fp, min(ts_s) t from {source} group by fp
  union all
  select j.fp, (select min(p.ts_s) from {source} p where p.fp = j.fp and p.ts_s >= j.t + 60) t
  from jumps j where (select min(p.ts_s) from {source} p where p.fp = j.fp and p.ts_s >= j.t + 60) is not null),
kept as (
  select p.* from {source} p join jumps j on p.fp = j.fp and p.ts_s = j.t
  qualify row_number() over (partition by p.fp, p.ts_s order by p.id) = 1)"""


def limit_sql(n: int) -> str:
    """Row by row inside sessions split by a 60 s gap, carrying the accepted times."""
    return f"""
gapped as (select *, case when ts_s - lag(ts_s) over (order by ts_s, id) < 60 then 0 else 1 end g from prints),
sessions as (select *, sum(g) over (order by ts_s, id rows unbounded preceding) s from gapped),
numbered as (select *, row_number() over (partition by s order by ts_s, id) rn from sessions),
walk as (
  select s, rn, id, true ok, [ts_s] acc from numbered where rn = 1
  union all
  select n.s, n.rn, n.id, len(list_filter(w.acc, lambda x: n.ts_s - x < 60)) < {n} ok,
    case when len(list_filter(w.acc, lambda x: n.ts_s - x < 60)) < {n}
      then list_append(list_filter(w.acc, lambda x: n.ts_s - x < 60), n.ts_s) else list_filter(w.acc, lambda x: n.ts_s - x < 60) end acc
  from walk w join numbered n on n.s = w.s and n.rn = w.rn + 1),
limited as (select p.* from prints p join walk w using (id) where w.ok)"""


ORACLES["dedup_alerts"] = f"with recursive {ALERTS}, {dedup_sql('prints')} select * exclude (fp) from kept"
ORACLES["rate_limit_alerts"] = f"with recursive {ALERTS}, {limit_sql(20)} select * exclude (fp) from limited"
ORACLES["admitted_alerts"] = f"""
with recursive {ALERTS}, {limit_sql(20)}, {dedup_sql('limited')} select * exclude (fp), 0 notified from kept
"""
ORACLES["mitre_enrich"] = f"with {ALERTS} select id, event_type, mitre_tactic, mitre_technique from alerts"
HOST_ALERTS = f"""{AUTH},
host_alerts as (
  select line_no source_id, ts ts_us, 'HOST' alert_type, severity, coalesce(source_ip, 'localhost') src_ip, 'localhost' dst_ip,
    0 src_port, 0 dst_port, '' protocol, description, {_TACTIC} mitre_tactic, {_TECHNIQUE} mitre_technique,
    cast(0.9 as double) confidence, 0 model_votes, '{{}}' raw_features
  from forced)"""
ORACLES["host_alerts"] = f"with {HOST_ALERTS} select * from host_alerts"
ORACLES["all_alerts"] = f"with {SIGNATURE_ALERTS}, {HOST_ALERTS} select * from sig_alerts union all by name select * from host_alerts"


def feed_text(c: str, mark: str = dims.NO_VALUE) -> str:
    return f"coalesce(cast({c} as varchar), '{mark}')"


_ISO = "strftime(make_timestamp(ts_us), '%Y-%m-%dT%H:%M:%S')"
ORACLES["alert_feed"] = f"""
with {ALERTS}
select id, {_ISO} "time", severity, alert_type "type", {feed_text('src_ip')} src, dst_ip || ':' || dst_port dst,
  substr(description, 1, 70) description, mitre_tactic mitre,
  case when confidence > 0 then cast(round(confidence * 100) as bigint) || '%' else '{dims.NO_VALUE}' end confidence
from alerts
where severity in ('CRITICAL', 'HIGH') and alert_type = 'NETWORK' and (contains(coalesce(src_ip, ''), '10.0.0.1') or contains(dst_ip, '10.0.0.1'))
"""
_COLOR = case("severity", dims.SEVERITY_COLORS, "'#333333'")
ORACLES["notification_outbox"] = f"""
with {ALERTS}, ranked as (select *, {case("severity", dims.SEVERITY_RANK, "0")} rk, {_ISO} iso, {_COLOR} color from alerts)
select id, 'email' channel, '[IDS ' || severity || '] ' || substr(description, 1, 60) title, color,
  'Timestamp: ' || iso || chr(10) || 'Type: ' || alert_type || chr(10) || 'Source IP: ' || coalesce(src_ip, '') || chr(10)
  || 'Destination IP: ' || dst_ip || chr(10) || 'Port: ' || dst_port || chr(10) || 'Description: ' || description || chr(10)
  || 'MITRE Tactic: ' || mitre_tactic || chr(10) || 'Confidence: ' || confidence body
from ranked where rk >= 3
union all
select id, 'slack', 'IDS Alert — ' || severity, color,
  '{{"Type":"' || alert_type || '","Source IP":"' || coalesce(src_ip, '-') || '","Dest IP":"' || dst_ip || '","Port":"' || dst_port
  || '","Description":"' || substr(description, 1, 200) || '","MITRE":"' || mitre_tactic || '","Confidence":"' || confidence || '"}}'
from ranked where rk >= 2
union all
select id, 'console', '[ALERT][' || severity || ']', color,
  '[ALERT][' || severity || '] ' || iso || ' | ' || coalesce(src_ip, '-') || ' → ' || dst_ip || ' | ' || substr(description, 1, 120)
from ranked
"""
ORACLES["acknowledged_alerts"] = f"""
with {ALERTS}
select id, severity, cast(id in (select o_orderkey from orders) as int) acknowledged from fx_alerts
"""
ORACLES["correlate_net_host"] = f"""
with {ALERTS}
select n.id, n.src_ip, count(*) host_events
from fx_alerts n join fx_alerts h on h.src_ip = n.src_ip and h.ts_s between n.ts_s - 300 and n.ts_s + 300
where n.event_type in ('PORT_SCAN', 'SYN_FLOOD') and h.event_type in ('AUTH_FAIL', 'SUDO') and n.src_ip <> '' group by n.id, n.src_ip
"""
ORACLES["suppress_allowlisted"] = f"""
with {ALERTS}
select id, src_ip from fx_alerts
where src_ip is null or src_ip not in (select '10.0.0.' || (n_nationkey * 5) from nation)
"""
ORACLES["severity_counts"] = f"with {ALERTS} select severity, count(*) cnt from fx_alerts group by severity"
ORACLES["alert_timeline"] = f"""
with {ALERTS}
select strftime(make_timestamp(ts_us), '%Y-%m-%dT%H:00:00') "hour", count(*) "count"
from alerts where ts_us between {AS_OF_US} - 3600000000 and {AS_OF_US} group by 1
"""
ORACLES["recent_alerts"] = f"with {ALERTS} select * from alerts where severity = 'HIGH' order by ts_us desc, id desc limit 100"
ORACLES["top_source_ips"] = f"""
with {ALERTS} select src_ip, count(*) cnt from fx_alerts where src_ip <> '' group by src_ip order by cnt desc, src_ip limit 10
"""
_MITRE = ", ".join(f"({texts(row)})" for row in dims.MITRE)
ORACLES["mitre_coverage"] = f"""
with {ALERTS}
select tactic, technique, m.name, count(a.id) alerts
from (values {_MITRE}) m(event_type, tactic, technique, name) left join fx_alerts a using (event_type) group by all
"""
ORACLES["report_summary"] = f"""
with {ALERTS}, span as (select * from alerts where ts_us between {AS_OF_US} - 3600000000 and {AS_OF_US})
select 'summary' "section", 'Total Alerts' "key", cast(count(*) as varchar) "text" from span
union all select 'summary', s, cast((select count(*) from span where severity = upper(s)) as varchar)
  from (values ('Critical'), ('High'), ('Medium'), ('Low')) v(s)
union all (select 'critical', cast(id as varchar), description || ' — ' || coalesce(src_ip, '') || ' → ' || dst_ip || ' '
  || strftime(make_timestamp(ts_us), '%Y-%m-%dT%H:%M') from span where severity = 'CRITICAL' order by ts_us desc, id desc limit 5)
"""

# ---- captures and identities ---------------------------------------------------------------------
ORACLES["pcap_scan"] = f"""
with {PACKETS}
select seq, ts_us, src_ip, dst_ip, protocol, length, 64 ttl, cast(src_port as int) src_port, cast(dst_port as int) dst_port, flags,
  case when protocol = 6 then seq else 0 end tcp_seq, case when protocol = 6 then seq + 1 else 0 end tcp_ack,
  case when protocol = 1 then 8 end icmp_type, case when protocol = 1 then 0 end icmp_code
from fx_packets
"""
ORACLES["pcap_files"] = ORACLES["pcap_scan"]
_LOGIN = ", ".join(
    f"nullif(regexp_extract(lower(regexp_extract(payload, '(?s)POST .*?\\r\\n\\r\\n(.*)', 1)), '{n}=([^&\\s]{{2,40}})', 1), '')"
    for n in dims.LOGIN_FIELDS
)
ORACLES["http_identity"] = f"""
with {with_views("fx_http")},
internal as (select * from fx_http where {_INTERNAL.format(c='src_ip')}),
evidence as (
  select seq, src_ip, 'os' field, substr(ua, 1, 120) v, 'OS from HTTP User-Agent' m
  from (select *, trim(regexp_extract(payload, 'User-Agent:([^\\r]*)', 1)) ua from internal) where contains(ua, 'Windows NT')
  union all
  select seq, src_ip, 'username', split_part(decode(from_base64(b)), ':', 1), 'Username from HTTP Basic Auth'
  from (select *, regexp_extract(payload, 'Authorization: Basic ([^\\r]*)', 1) b from internal) where b <> ''
  union all
  select seq, src_ip, 'username', coalesce({_LOGIN}) f, 'Username from HTTP POST body' from internal where f is not null),
firsts as (select * from evidence qualify row_number() over (partition by src_ip, field order by seq, m, v) = 1),
wide as (
  select src_ip host_ip, max(v) filter (field = 'username') username, max(v) filter (field = 'os') os,
    string_agg(m, '; ' order by seq, m) sources
  from firsts group by src_ip)
select host_ip, username, os,
  case when regexp_matches(username, '^[A-Za-z]+\\.[A-Za-z]+$')
    then upper(substr(split_part(username, '.', 1), 1, 1)) || lower(substr(split_part(username, '.', 1), 2)) || ' '
      || upper(substr(split_part(username, '.', 2), 1, 1)) || lower(substr(split_part(username, '.', 2), 2)) || ' (inferred from account name)' end fullname,
  sources || case when fullname is not null then '; Full name inferred from username dot-notation pattern' else '' end sources
from wide
"""

# ---- labelled flows --------------------------------------------------------------------------------
LABELLED = with_views("fx_labelled")
_NUM = ["dst_port", "protocol", "fwd_packets", "bwd_packets", "fwd_bytes", "bwd_bytes", "flow_bytes_s"]


def finite_sql(c: str) -> str:
    return f"case when isfinite(cast({c} as double)) then cast({c} as double) end"


ORACLES["label_clean"] = f"""
with {LABELLED}
select src_ip, dst_ip, "label", cast("label" <> 'BENIGN' as int) binary_label,
  {", ".join(f"least(greatest(coalesce({finite_sql(c)}, 0), 0), 1e9) {c}" for c in _NUM)}
from fx_labelled where "label" is not null
"""
ORACLES["label_distribution"] = f"""
with {LABELLED}, total as (select count(*) t from fx_labelled)
select 'label' "section", "label" "name", count(*) n, round(count(*) / max(t), 6) rate from fx_labelled, total where "label" is not null group by "label"
union all
select 'total', case when "label" = 'BENIGN' then 'Benign' else 'Attacks' end nm, count(*), round(count(*) / max(t), 6) from fx_labelled, total group by nm
"""
_LONG = " union all ".join(f"select '{c}' feature, {finite_sql(c)} v, isinf(cast({c} as double)) inf from fx_labelled" for c in _NUM)
ORACLES["feature_spread"] = f"""
with {LABELLED}, long as ({_LONG})
select feature, round(stddev_samp(v), 4) std from long group by feature having not coalesce(bool_or(inf), false) order by 2 desc, 1 limit 6
"""
ORACLES["trimmed_box_stats"] = f"""
with {LABELLED}, long as (select * from ({_LONG}) where v is not null),
tops as (select feature, quantile_cont(v, 0.99) top from long group by feature)
select feature, count(*) n, min(v) low, round(quantile_cont(v, 0.25), 6) q1, round(median(v), 6) median,
  round(quantile_cont(v, 0.75), 6) q3, round(max(v), 6) high
from long join tops using (feature) where v < top group by feature
"""
ORACLES["trimmed_box_stats"] = ORACLES["trimmed_box_stats"].replace("min(v) low", "round(min(v), 6) low")
_ATTACK = """coalesce("label" <> 'BENIGN', true)"""
ORACLES["top_attack_sources"] = f"""
with {LABELLED} select src_ip, count(*) n from fx_labelled where {_ATTACK} group by src_ip order by n desc, src_ip limit 10
"""
ORACLES["top_attack_ports"] = f"""
with {LABELLED}
select dst_port, count(*) n, ':' || dst_port || ' (' || {case("dst_port", SERVICES, "''")} || ')' "label",
  case when dst_port in ({ports(dims.CAPTURE_BAD_PORTS)}) then 'bad'
    when dst_port in ({ports(dims.CAPTURE_SENSITIVE_PORTS)}) then 'sensitive' else '' end watch
from fx_labelled where {_ATTACK} group by dst_port order by n desc, dst_port limit 15
"""
ORACLES["top_protocols"] = f"""
with {LABELLED}
select protocol, count(*) n, {case("protocol", dims.PROTOCOLS, "cast(protocol as varchar)")} "name"
from fx_labelled group by protocol order by n desc, protocol limit 8
"""

# ---- models ------------------------------------------------------------------------------------------
_S = {m: f"coalesce({m}_score, 0)" for m in dims.MODEL_WEIGHTS}
VOTED = f"""{with_views("fx_scored")},
votes as (select *, {" + ".join(f"cast({_S[m]} >= {dims.VOTE_THRESHOLDS[m]} as int)" for m in _S)} votes from fx_scored),
voted as (
  select *, cast(votes >= {dims.VOTES_NEEDED} as int) predicted,
    cast(round({" + ".join(f"cast({w} as decimal(4,2)) * cast(round({_S[m]}, 4) as decimal(9,4))" for m, w in dims.MODEL_WEIGHTS.items())}, 4) as double) confidence
  from votes)"""
ORACLES["ensemble_vote"] = f"with {VOTED} select * from voted"
VOTED_FLOWS = f"{flow_ctes()}, {VOTED}, vf as (select fl.*, votes, predicted, confidence from fl join voted using (flow_id))"
_BAND = " ".join(f"when confidence >= {floor} then '{s}'" for floor, s in dims.CONFIDENCE_BANDS)
ORACLES["ml_alerts"] = f"""
with {VOTED_FLOWS}
select flow_id source_id, start_us ts_us, 'NETWORK' alert_type, case {_BAND} else 'LOW' end severity, src_ip, dst_ip, src_port, dst_port,
  cast(protocol as varchar) protocol,
  'ML anomaly detected: confidence=' || printf('%.2f', round(confidence * 100, 2)) || '%, votes=' || votes || '/3' description,
  'Unknown' mitre_tactic, 'Unknown' mitre_technique, confidence, votes model_votes, '{{}}' raw_features
from vf where predicted = 1
"""
ORACLES["network_events"] = f"""
with {VOTED_FLOWS}
select start_us ts_us, src_ip, dst_ip, src_port, dst_port, cast(protocol as varchar) protocol, fwd_bytes bytes_sent,
  bwd_bytes bytes_recv, total_packets packets, round(duration_ms, 3) duration_ms, flags, confidence anomaly_score,
  case when predicted = 1 then 'attack' else 'benign' end "label"
from vf
"""
ORACLES["host_events"] = f"""
with {AUTH}
select ts, event_type, hostname, "user", substr(description, 1, 500) description, cast(0.9 as double) anomaly_score from auth
"""
ORACLES["scoring_stats"] = f"""
with {VOTED}
select count(*) total_scored, cast(sum(predicted) as bigint) total_flagged, round(sum(predicted) / count(*) * 100, 2) flag_rate_pct from voted
"""
ORACLES["score_calibration"] = f"""
with {VOTED}
select round(avg(ae_score), 6) mean, round(stddev_pop(ae_score), 6) std, round(avg(ae_score) + 3 * stddev_pop(ae_score), 6) threshold
from fx_scored
"""
REPORT = f"""{VOTED},
k as (
  select c, count(*) filter ("label" = c and predicted = c) tp, count(*) filter (predicted = c) pr, count(*) filter ("label" = c) tr,
    count(*) tot, count(*) filter ("label" = predicted) hit
  from voted, (values (0), (1)) v(c) group by c),
r as (
  select c, tot, hit, tr, case when pr > 0 then tp / pr else 0 end p, case when tr > 0 then tp / tr else 0 end r,
    case when pr + tr > 0 then 2 * tp / (pr + tr) else 0 end f from k),
report as (
  select case c when 0 then 'BENIGN' else 'ATTACK' end "name", p "precision", r recall, f f1, tr support from r
  union all select 'accuracy', null, null, any_value(hit / tot), any_value(tot) from r
  union all select 'macro avg', avg(p), avg(r), avg(f), any_value(tot) from r
  union all select 'weighted avg', sum(p * tr / tot), sum(r * tr / tot), sum(f * tr / tot), any_value(tot) from r)"""
ORACLES["classification_report"] = f"""
with {REPORT}
select "name", round("precision", 6) "precision", round(recall, 6) recall, round(f1, 6) f1, support from report
"""
ORACLES["model_performance"] = f"""
with {REPORT}
select 'ensemble' model_name, round("precision", 6) precision_val, round(recall, 6) recall_val, round(f1, 6) f1_score,
  (select round(1 - recall, 6) from report where "name" = 'BENIGN') false_pos_rate, (select any_value(support) from report where "name" = 'accuracy') total_scored
from report where "name" = 'ATTACK'
"""
ORACLES["roc_auc"] = f"""
with {VOTED},
long as ({" union all ".join(f"select '{m}' model, coalesce({m}, 0) s, label y from voted" for m in ("if_score", "rf_score", "ae_score", "confidence"))}),
ranks as (
  select *, rank() over (partition by model order by s) + (count(*) over (partition by model, s) - 1) / 2.0 rk from long)
select model, round((sum(cast(rk as double)) filter (y = 1) - count(*) filter (y = 1) * (count(*) filter (y = 1) + 1) / 2)
  / (count(*) filter (y = 1) * count(*) filter (y = 0)), 6) auc
from ranks group by model
"""
ORACLES["stratified_split"] = f"""
with {LABELLED}, n as (
  select cast("label" <> 'BENIGN' as int) binary_label, count(*) n from fx_labelled where "label" is not null group by 1)
select binary_label, 'test' part, cast(round(n * 0.2) as bigint) n from n
union all select binary_label, 'train', n - cast(round(n * 0.2) as bigint) from n
"""

ROLES = f"""{flow_ctes(1000)},
labelled as (select f.*, cast(p.role in ('scan', 'syn', 'c2', 'dns', 'icmp') as int) y from fl f join fx_packets p on p.seq = f.flow_id)"""
ORACLES["isolation_forest_scores"] = f"with {ROLES} select count(*) \"rows\", count(*) scored, true in_range, true flags_few from labelled"
for _name in ("random_forest_scores", "autoencoder_scores"):
    ORACLES[_name] = f"""
with {ROLES}
select count(*) "rows", count(*) scored, count(*) filter (y = 1) attacks, true in_range, true separates from labelled
"""
ORACLES["isolation_forest_fixed"] = f"""
with {flow_ctes(1000)}, {FEATURES},
x as (select flow_id, (cast(cast(total_packets as float) as double) - 2) / 1.5 p, (cast(cast(total_bytes as float) as double) - 500) / 800 b from features),
d as (select flow_id, case when p <= 0.5 then 4 when b <= 1 then 3 else 2 end + case when b <= 0 then 5 else 1.5 end total from x)
select flow_id, round(least(greatest(0.5 - (-pow(2, -cast(total as double) / 2 / (2 * (ln(15) + 0.57721566490153286) - 2 * 15 / 16.0)) + 0.45), 0), 1), 6) if_score from d
"""
ORACLES["feature_importance"] = " union all ".join(f"select '{c}' feature, true not_negative, true sum_is_one" for c in dims.FEATURES)
ORACLES["autoencoder_fixed"] = f"""
with {flow_ctes(1000)}, {FEATURES},
e as (select flow_id, ({" + ".join(f"pow(0.5 - (cast(cast({c} as float) as double) - 1) / 10, 2)" for c in dims.FEATURES)}) / 24 err from features)
select flow_id, round(least(greatest((err - 2000) / (9000 + 1e-8) / 6 + 0.5, 0), 1), 6) ae_score from e
"""
ORACLES["train_report"] = f"""
with {ROLES},
n as (select y, cast(round(count(*) * 0.2) as bigint) n from labelled group by y),
lines as (
  select case y when 0 then 'BENIGN' else 'ATTACK' end "name", n support from n
  union all select v, (select cast(sum(n) as bigint) from n) from (values ('accuracy'), ('macro avg'), ('weighted avg')) t(v))
select model, "name", support, true in_range, true separates from lines, (values ('if'), ('rf'), ('ae'), ('ensemble')) m(model)
"""
ORACLES["score_flows"] = f"with {flow_ctes(1000)} select flow_id, true in_range, true vote_fits, total_packets packets from fl"
ORACLES["stream_scoring"] = f"with {flow_ctes(1000)} select flow_id, true in_range, true vote_fits from fl"

# ---- streams -------------------------------------------------------------------------------------------
ORACLES["stream_flows"] = ORACLES["flows"]
ORACLES["stream_signatures"] = f"with {SIGNATURE_ALERTS} select {SIG_COLUMNS} from picked"
ORACLES["stream_brute_force"] = ORACLES["auth_brute_force"]
ORACLES["stream_admitted_alerts"] = ORACLES["admitted_alerts"]
ORACLES["stream_process_anomalies"] = ORACLES["process_anomalies"]
ORACLES["stream_traffic_rate"] = f"""
with {PACKETS}
select (ts_us // 60000000) * 60000000 "start", count(*) packets, cast(sum(length) as bigint) bytes,
  count(*) filter (protocol = 6 and contains(flags, 'S')) syns
from fx_packets group by 1 having (ts_us // 60000000) * 60000000 + 60000000 <= (select max(ts_us) from fx_packets) - 30000000
"""
ORACLES["stream_log_brute_force"] = f"select * exclude (line_no) from ({ORACLES['auth_brute_force']})"

ORACLES["stream_log_tail"] = f"""
with {with_views("fx_log_lines")},
l as (select line_no, line, regexp_split_to_array(line, '\\s+')[4] host from fx_log_lines)
select host, trim(line, ' ') line from l
union all select distinct host, 'unfinished left' from l
"""

ORACLES["stream_alert_sinks"] = f"""
with kept as ({ORACLES["admitted_alerts"]})
select *, 'first' sink from kept union all select *, 'second' from kept
"""
ORACLES["stream_file_integrity"] = ORACLES["file_integrity_diff"]


def both_sites(text: str, *times: str) -> str:
    """The rows once for each of two sensors; the second one's times are a micro-second later."""
    later = ", ".join(f"{t} + 1 as {t}" for t in times)
    return f"""
with one as ({text})
select 'site a' sensor, * from one union all select 'site b', * {f"replace ({later})" if times else ""} from one
"""


ORACLES["sensor_flows"] = both_sites(ORACLES["flows"], "start_us", "end_us")
ORACLES["sensor_signatures"] = both_sites(ORACLES["stream_signatures"], "start_us")
ORACLES["stream_sensor_flows"] = ORACLES["sensor_flows"]
ORACLES["stream_sensor_signatures"] = ORACLES["sensor_signatures"]
ORACLES["stream_process_anomalies_gaps"] = ORACLES["process_anomalies_gaps"]
ORACLES["sensor_hits"] = both_sites(ORACLES["all_hits"], "ts_us")
ORACLES["sensor_profiles"] = both_sites(ORACLES["attacker_profiles"])
ORACLES["sensor_kpis"] = both_sites(ORACLES["capture_kpis"])
