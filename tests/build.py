"""Small message tables for tests."""

from planeweave import schemas


def nas(name=None, **more):
    row = {"name": name, "protected": False, "shdr": None, "inner": None, "cause": None,
           "cause_name": None, "ciph_algo": None, "integ_algo": None, "supi": None, "guti": None,
           "unparsed": None}
    row.update(more)
    return tuple(row.values())


def n2(spark, rows):
    """rows: dicts over the N2 message schema; msg_no and ts default to the position."""
    out = []
    for i, r in enumerate(rows):
        base = {"run_id": "r", "msg_no": i, "ts": float(i), "src_ip": "10.0.0.1",
                "dst_ip": "10.0.0.2", "sport": 40000, "dport": 38412, "stream_id": 0, "ngap": None,
                "kind": None, "proc_code": None, "ran_ue_id": 1, "amf_ue_id": 10, "nas": None,
                "f_teids": None, "unparsed": None}
        base.update(r)
        out.append(tuple(base.values()))
    return spark.createDataFrame(out, schemas.N2_MESSAGES)


def n4(spark, rows):
    names = {50: "PFCP Session Establishment Request", 51: "PFCP Session Establishment Response",
             1: "PFCP Heartbeat Request", 2: "PFCP Heartbeat Response"}
    out = []
    for i, r in enumerate(rows):
        base = {"run_id": "r", "msg_no": i, "ts": float(i), "src_ip": "s", "dst_ip": "u",
                "src_port": 8805, "dst_port": 8805, "msg_type": 50, "name": None, "seq": 1,
                "seid": None, "cause": None, "cause_code": None, "f_teids": None, "ue_ip": None,
                "user_id": None, "unparsed": None}
        base.update(r)
        base["name"] = base["name"] or names.get(base["msg_type"])
        out.append(tuple(base.values()))
    return spark.createDataFrame(out, schemas.N4_MESSAGES)


def sbi(spark, rows):
    """Raw SBI messages (before naming): conn endpoints, path, body and note."""
    schema = """run_id string, msg_no bigint, ts double, src_ip string, dst_ip string, src_port int,
      dst_port int, stream_id bigint, direction string, method string, path string, status int,
      body string, note string"""
    out = []
    for i, r in enumerate(rows):
        base = {"run_id": "r", "msg_no": i, "ts": float(i), "src_ip": "a", "dst_ip": "b",
                "src_port": 1, "dst_port": 7777, "stream_id": 1, "direction": "request",
                "method": None, "path": None, "status": None, "body": None, "note": None}
        base.update(r)
        out.append(tuple(base.values()))
    return spark.createDataFrame(out, schema)


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
