"""Reports and manifests as rows of text: JSON or XML by Spark's own writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The registry of ancillary packets by DID (type 1), and by DID and SDID (type 2).
TYPE_1 = (
    (0x80, "[S291] Packet marked for deletion"),
    (0x84, "[S291] End packet deleted  (Deprecated; revision of ST291-2010)"),
    (0x88, "[S291] Start packet deleted (Deprecated; revision of ST291-2010)"),
    (0xa0, "[ST 299-2] Audio data in HANC space (3G) - Group 8 Control pkt"),
    (0xa1, "[ST 299-2] Audio data in HANC space (3G) - Group 7 Control pkt"),
    (0xa2, "[ST 299-2] Audio data in HANC space (3G) - Group 6 Control pkt"),
    (0xa3, "[ST 299-2] Audio data in HANC space (3G) - Group 5 Control pkt"),
    (0xa4, "[ST 299-2] Audio data in HANC space (3G) - Group 8"),
    (0xa5, "[ST 299-2] Audio data in HANC space (3G) - Group 7"),
    (0xa6, "[ST 299-2] Audio data in HANC space (3G) - Group 6"),
    (0xa7, "[ST 299-2] Audio data in HANC space (3G) - Group 5"),
    (0xe0, "[ST 299-1] Audio data in HANC space (HDTV)"),
    (0xe1, "[ST 299-1] Audio data in HANC space (HDTV)"),
    (0xe2, "[ST 299-1] Audio data in HANC space (HDTV)"),
    (0xe3, "[ST 299-1] Audio data in HANC space (HDTV)"),
    (0xe4, "[ST 299-1] Audio data in HANC space (HDTV)"),
    (0xe5, "[ST 299-1] Audio data in HANC space (HDTV)"),
    (0xe6, "[ST 299-1] Audio data in HANC space (HDTV)"),
    (0xe7, "[ST 299-1] Audio data in HANC space (HDTV)"),
    (0xec, "[S272] Audio Data in HANC space (SDTV)"),
    (0xed, "[S272] Audio Data in HANC space (SDTV)"),
    (0xee, "[S272] Audio Data in HANC space (SDTV)"),
    (0xef, "[S272] Audio Data in HANC space (SDTV)"),
    (0xf0, "[S315] Camera position (HANC or VANC space)"),
    (0xf4, "[RP165] Error Detection and Handling (HANC space)"),
    (0xf8, "[S272] Audio Data in HANC space (SDTV)"),
    (0xf9, "[S272] Audio Data in HANC space (SDTV)"),
    (0xfa, "[S272] Audio Data in HANC space (SDTV)"),
    (0xfb, "[S272] Audio Data in HANC space (SDTV)"),
    (0xfc, "[S272] Audio Data in HANC space (SDTV)"),
    (0xfd, "[S272] Audio Data in HANC space (SDTV)"),
    (0xfe, "[S272] Audio Data in HANC space (SDTV)"),
    (0xff, "[S272] Audio Data in HANC space (SDTV)"),
)
TYPE_2 = (
    (0x08, 0x08, "[S353] MPEG recoding data, VANC space"),
    (0x08, 0x0c, "[S353] MPEG recoding data, HANC space"),
    (0x40, 0x01, "[S305] SDTI transport in active frame space"),
    (0x40, 0x02, "[S348] HD-SDTI transport in active frame space"),
    (0x40, 0x04, "[S427] Link Encryption Message 1"),
    (0x40, 0x05, "[S427] Link Encryption Message 2"),
    (0x40, 0x06, "[S427] Link Encryption Metadata"),
    (0x41, 0x01, "[S352] Payload Identification , HANC space"),
    (0x41, 0x05, "[S2016-3] AFD and Bar Data"),
    (0x41, 0x06, "[S2016-4] Pan-Scan Data"),
    (0x41, 0x07, "[S2010] ANSI/SCTE 104 messages"),
    (0x41, 0x08, "[S2031] DVB/SCTE VBI data"),
    (0x41, 0x09, "[ST 2056 (pending approval)] MPEG TS packets in VANC"),
    (0x41, 0x0a, "[ST 2068 (Pending Approval)] Stereoscopic 3D Frame Compatible Packing and Signaling"),
    (0x43, 0x01, "[ITU-R BT.1685] Structure of inter-station control data conveyed by ancillary data packets"),
    (0x43, 0x02, "[RDD 8] (OP-47) Subtitling Distribution packet (SDP)"),
    (0x43, 0x03, "[RDD 8] (OP-47) Transport of ANC packet in an ANC Multipacket"),
    (0x43, 0x04, "[ARIB TR-B29] Metadata to monitor errors of audio and video signals on a broadcasting chain ARIB http://www.arib.or.jp/english/html/overview/archives/br/8-TR-B29v1_0-E1.pdf"),
    (0x43, 0x05, "[RDD18] Acquisition Metadata Sets for Video Camera Parameters"),
    (0x44, 0x04, "[RP214] KLV Metadata transport in VANC space"),
    (0x44, 0x14, "[RP214] KLV Metadata transport in HANC space"),
    (0x44, 0x44, "[RP223] Packing UMID and Program Identification Label Data into SMPTE 291M Ancillary Data Packets"),
    (0x45, 0x01, "[S2020-1] Compressed Audio Metadata"),
    (0x45, 0x02, "[S2020-1] Compressed Audio Metadata"),
    (0x45, 0x03, "[S2020-1] Compressed Audio Metadata"),
    (0x45, 0x04, "[S2020-1] Compressed Audio Metadata"),
    (0x45, 0x05, "[S2020-1] Compressed Audio Metadata"),
    (0x45, 0x06, "[S2020-1] Compressed Audio Metadata"),
    (0x45, 0x07, "[S2020-1] Compressed Audio Metadata"),
    (0x45, 0x08, "[S2020-1] Compressed Audio Metadata"),
    (0x45, 0x09, "[S2020-1] Compressed Audio Metadata"),
    (0x46, 0x01, "[ST 2051] Two Frame Marker in HANC"),
    (0x50, 0x01, "[RDD 8] (OP-47) WSS data per RDD 8"),
    (0x51, 0x01, "[RP215] Film Codes in VANC space"),
    (0x60, 0x60, "[S12M-2] Ancillary Time Code"),
    (0x61, 0x01, "[S334-1] EIA 708B Data mapping into VANC space"),
    (0x61, 0x02, "[S334-1] EIA 608 Data mapping into VANC space"),
    (0x62, 0x01, "[RP207] Program Description in VANC space"),
    (0x62, 0x02, "[S334-1] Data broadcast (DTV) in VANC space"),
    (0x62, 0x03, "[RP208] VBI Data in VANC space"),
    (0x64, 0x64, "[RP196 (Withdrawn)] Time Code in HANC space (Deprecated; for reference only)"),
    (0x64, 0x7f, "[RP196 (Withdrawn)] VITC in HANC space (Deprecated; for reference only)"),
)


def packet_name(did: Column, sdid: Column) -> Column:
    """Name of a packet (type 1 from DID 0x80 on, else type 2); null if unknown."""
    one = F.create_map(*(F.lit(x) for pair in TYPE_1 for x in pair))
    two = F.create_map(*(F.lit(x) for d, s, name in TYPE_2 for x in (d * 256 + s, name)))
    return F.when(did >= 0x80, F.try_element_at(one, did.cast("int"))).otherwise(F.try_element_at(two, (did * 256 + sdid).cast("int")))


def clip_report(clips: DataFrame, tracks: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """``report``: a JSON object for each clip, with its tracks in order."""
    fields = [c for c in tracks.columns if c != key]
    own = tracks.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.struct(*order).alias("o"), F.struct(*fields).alias("t")))).alias("_t"))
    joined = clips.join(own, key, "left").withColumn("tracks", F.transform(F.coalesce("_t", F.array()), lambda x: x["t"])).drop("_t")
    return joined.select(key, F.to_json(F.struct(*joined.columns)).alias("report"))


def manifest_xml(files: DataFrame, key: str, order: str) -> DataFrame:
    """``manifest``: a list of files with size and checksum for each bundle, in order of registration."""
    item = F.concat(F.lit("<File><Name>"), _escape(F.col("name")), F.lit("</Name><Size>"), F.col("size").cast("string"), F.lit('</Size><Checksum type="md5">'), F.col("md5"), F.lit("</Checksum></File>"))
    rows = files.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), item.alias("x")))).alias("_f"))
    return rows.select(key, F.concat(F.lit("<Manifest><FileList>"), F.concat_ws("", F.transform("_f", lambda x: x["x"])), F.lit("</FileList></Manifest>")).alias("manifest"))


def _escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def sections(rows: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """``name : value`` lines of the columns ``names``, padded to a column, one text for each row."""
    width = max(map(len, names))
    return rows.select(*keys, F.concat_ws("\n", *(F.concat(F.lit(f"{n:<{width}} : "), F.coalesce(F.col(n).cast("string"), F.lit(""))) for n in names)).alias("report"))
