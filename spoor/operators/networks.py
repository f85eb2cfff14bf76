"""Addresses within ranges, IPv4 and IPv6, by columns and equi-joins.

An address is its 32 or 128 bits as text, so a range holds it if the range's leading bits are its own. Only distinct addresses
are taken apart, and they meet ranges by (width, length, leading bits), never each range.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoor.functions import attributes as A

#: Plugins that list sockets, and addresses that are no peer.
NETWORK_PLUGINS = ("windows.netscan", "windows.netstat")
NO_PEER = ("*", "", "0.0.0.0", "::", "0.0.0.0:0", "-")


def ipv4_number(address: Column) -> Column:
    """null for what is no dotted quad; a part with a leading zero isn't one."""
    octet = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    p = F.split(F.trim(address), r"\.")
    n = sum((F.get(p, F.lit(i)).try_cast("long") * (1 << 8 * (3 - i)) for i in range(1, 4)), F.get(p, F.lit(0)).try_cast("long") * (1 << 24))
    return F.when(F.trim(address).rlike(rf"^(?:{octet}\.){{3}}{octet}$"), n)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value evaluated once however often then names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _ipv6_bits(text: Column) -> Column:
    none = F.array().cast("array<string>")

    def plain(bare: Column) -> Column:  # a dotted tail stands for the last two groups
        groups = lambda n: F.lower(F.concat(F.regexp_extract(bare, r"^(.*:)[^:]*$", 1), F.hex(F.shiftright(n, 16)), F.lit(":"), F.hex(n.bitwiseAND(65535))))
        return _let(F.regexp_extract(bare, r":([^:]*\.[^:]*)$", 1), lambda tail: F.when(tail == "", bare).otherwise(_let(ipv4_number(tail), groups)))

    def bits(sides: Column) -> Column:  # the groups before and after ::
        known = F.flatten(sides)
        gap = 8 - F.size(known)
        valid = F.forall(known, lambda g: g.rlike("^[0-9a-f]{1,4}$")) & (((F.size(sides) == 1) & (gap == 0)) | ((F.size(sides) == 2) & (gap > 0)))
        groups = F.concat(F.get(sides, F.lit(0)), F.array_repeat(F.lit("0"), gap), F.coalesce(F.get(sides, F.lit(1)), none))
        return F.when(valid, F.array_join(F.transform(groups, lambda g: F.lpad(F.conv(g, 16, 2), 16, "0")), ""))

    split = lambda t: F.transform(F.split(t, "::"), lambda side: F.when(side == "", none).otherwise(F.split(side, ":")))
    return _let(split(_let(F.regexp_replace(text, "%[^%]+$", ""), plain)), bits)


def address_bits(address: Column) -> Column:
    """The 32 or 128 bits of an address as text; null for what is no address. A zone (after %) is left out."""
    return _let(F.lower(F.trim(address)), lambda t: F.when(t.contains(":"), _ipv6_bits(t)).otherwise(F.lpad(F.bin(ipv4_number(t)), 32, "0")))


def _prefix_length(given: Column, width: Column) -> Column:
    """Digits, or for IPv4 a net mask or host mask."""
    ones = lambda mask: F.char_length(F.regexp_replace(mask, "0", ""))
    masked = _let(F.lpad(F.bin(ipv4_number(given)), 32, "0"), lambda mask: F.when(mask.rlike("^1*0*$"), ones(mask)).when(mask.rlike("^0*1*$"), 32 - ones(mask)))
    return F.when(given.isNull(), width).when(given.rlike(r"^[0-9]{1,9}$"), given.try_cast("int")).when(width == 32, masked)


def _network_text(bits: Column, length: Column) -> Column:
    """The range as usually written: bits' host part is zero, an IPv6 range's first longest run of zero groups is ::."""

    def short(groups: Column) -> Column:
        found = groups
        for n in range(2, 9):  # the longest is asked for first
            run = f"(?:^|:)0(?::0){{{n - 1}}}(?::|$)"
            found = F.when(groups.rlike(run), F.regexp_replace(groups, f"^(.*?){run}(.*)$", "$1::$2")).otherwise(found)
        return found

    quad = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.conv(F.substr(bits, i * 8 + 1, F.lit(8)), 2, 10)), ".")
    groups = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.lower(F.conv(F.substr(bits, i * 16 + 1, F.lit(16)), 2, 16))), ":")
    return F.concat(F.when(F.char_length(bits) == 32, quad).otherwise(_let(groups, short)), F.lit("/"), length.cast("string"))


def network(cidr: Column) -> Column:
    """(version, width, length, head, network) of an address or range, host bits set or not; null for anything else. head is the leading bits."""

    def made(bits: Column, length: Column) -> Column:
        width, head = F.char_length(bits), F.left(bits, length)
        text = _let(F.rpad(head, width, "0"), lambda b: _network_text(b, length))
        return F.when(length.between(0, width), F.struct(F.when(width == 32, 4).otherwise(6).alias("version"), width.alias("width"), length.alias("length"), head.alias("head"), text.alias("network")))

    def parsed(parts: Column) -> Column:
        size = lambda bits: _prefix_length(F.get(parts, F.lit(1)), F.char_length(bits))
        return F.when(F.size(parts) <= 2, _let(address_bits(F.get(parts, F.lit(0))), lambda bits: _let(size(bits), lambda length: made(bits, length))))

    return _let(F.split(F.trim(cidr), "/"), parsed)


def parse_networks(networks: DataFrame) -> DataFrame:
    """networks(cidr, ...) that are addresses or ranges, with the fields of network(); others go."""
    return networks.withColumn("_net", network(F.col("cidr"))).where("_net is not null").select(*networks.columns, "_net.*")


def match_networks(addresses: DataFrame, networks: DataFrame) -> DataFrame:
    """(address, name, cidr, network) of addresses(address) in networks(position, name, cidr): the first in list order of each address. Nulls and what is no address match nothing."""
    nets = parse_networks(networks).select("position", "name", "cidr", "network", "width", "length", "head")
    lengths = nets.agg(F.collect_set(F.struct("width", "length")).alias("lengths"))  # at most 33 + 129
    rows = addresses.select("address").distinct().withColumn("bits", address_bits(F.col("address"))).where("bits is not null")
    keyed = rows.crossJoin(F.broadcast(lengths)).select("address", "bits", F.explode("lengths").alias("at")).where(F.char_length("bits") == F.col("at.width"))
    hit = keyed.select("address", "at.*", F.left("bits", F.col("at.length")).alias("head")).join(nets, ["width", "length", "head"])
    first = hit.groupBy("address").agg(F.min_by(F.struct("name", "cidr", "network"), "position").alias("n"))
    return first.select("address", "n.*")


def endpoints(evidence: DataFrame, attributes: Column, *, remote: str = "foreignaddr", local: str = "localaddr", remote_port: str = "foreignport", local_port: str = "localport") -> DataFrame:
    """(investigation_id, id, plugin, role, address, port, state), two rows for each row of a socket plugin that has attributes.

    address is null where it names no peer. port is the remote one, else (missing or 0) the local one; state may be null. The caller
    gives rows of completed executions only."""
    rows = evidence.where(F.col("plugin").isin(*NETWORK_PLUGINS)).withColumn("_at", attributes).where("_at is not null")
    value = lambda key: F.trim(A.first_key(F.col("_at"), key))
    peer = lambda key: F.when(~value(key).isin(*NO_PEER), value(key))
    given = lambda key: F.when(~value(key).isin("", "0"), value(key))
    ends = F.explode(F.array(*(F.struct(F.lit(role).alias("role"), peer(key).alias("address")) for role, key in (("remote", remote), ("local", local)))))
    port = F.coalesce(given(remote_port), value(local_port))
    return rows.select("investigation_id", "id", "plugin", ends.alias("end"), port.alias("port"), F.when(value("state") != "", value("state")).alias("state")).select("investigation_id", "id", "plugin", "end.*", "port", "state")


def scan_networks(ends: DataFrame, networks: DataFrame) -> DataFrame:
    """(investigation_id, address, name, network, id, role, detail), each once: the endpoints() whose address lies in one of networks(position, name, cidr)."""
    detail = F.concat(F.col("role"), F.lit(" address "), F.col("address"), F.lit(" port "), F.coalesce("port", F.lit("None")), F.lit(" state "), F.coalesce("state", F.lit("n/a")), F.lit(" via "), F.col("plugin"))
    found = match_networks(ends.where("address is not null"), networks)
    return ends.join(found, "address").select("investigation_id", "address", "name", "network", "id", "role", detail.alias("detail")).distinct()


def summarize_scan(scanned: DataFrame) -> DataFrame:
    """Per address its network, number of rows, first row, roles, and number of details; the rows themselves stay in scan_networks()."""
    return scanned.groupBy("investigation_id", "address", "name", "network").agg(F.count_distinct("id").alias("n_rows"), F.min("id").alias("first_id"), F.array_join(F.sort_array(F.collect_set("role")), ",").alias("roles"), F.count_distinct("detail").alias("n_details"))


def scan_totals(ends: DataFrame) -> DataFrame:
    """Per investigation what a scan looked at: rows, distinct addresses, plugins."""
    return ends.groupBy("investigation_id").agg(F.count_if(F.col("role") == "remote").alias("rows_examined"), F.count_distinct("address").alias("distinct_addresses"), F.array_join(F.sort_array(F.collect_set("plugin")), ",").alias("plugins"))
