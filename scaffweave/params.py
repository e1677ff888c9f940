"""Run configuration of a scaffolding job."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from statistics import NormalDist

_OPTIONS = {
    "-f": "file", "--file": "file", "-s": "seq_id", "--seq_id": "seq_id", "-c": "min_reads", "--min_reads": "min_reads",
    "-l": "min_links", "--min_links": "min_links", "-z": "min_size", "--min_size": "min_size", "-d": "max_degree",
    "--max_degree": "max_degree", "-e": "end_length", "--end_length": "end_length", "-r": "error_percent",
    "--error_percent": "error_percent", "-k": "k_value", "--k_value": "k_value", "-j": "j_index", "--j_index": "j_index",
    "-B": "dist_bin_size", "--bin_size": "dist_bin_size", "--gap": "gap", "-u": "multfile", "--multfile": "multfile",
    "-b": "base_name", "--base_name": "base_name", "-g": "dist_graph_name", "--graph": "dist_graph_name",
    "--tsv": "tsv_name", "--barcode-counts": "barcode_counts", "--dist_tsv": "dist_tsv", "--samples_tsv": "samples_tsv",
    "-a": "fof_name", "--fofName": "fof_name",
}
_FLAGS = {
    "-D": ("dist_est", True), "--dist_est": ("dist_est", True), "--no_dist_est": ("dist_est", False),
    "--dist_median": ("dist_mode", "median"), "--dist_upper": ("dist_mode", "upper"),
    "-P": ("output_pair", True), "--pair": ("output_pair", True), "--kmers": ("kmer_mode", True),
}


@dataclass(frozen=True)
class ScaffoldParams:
    """Options and their defaults; mode-specific ones may not be mixed."""

    file: str = ""
    fof_name: str = ""
    multfile: str = ""
    seq_id: int = 98
    min_reads: int = 5
    min_links: int = 0
    min_size: int = 500
    min_mult: int = 50
    max_mult: int = 10000
    max_degree: int = 0
    end_length: int = 30000
    error_percent: float = 0.05
    k_value: int = 30
    j_index: float = 0.55
    dist_est: bool = False
    dist_bin_size: int = 20
    dist_mode: str = "median"
    gap: int = 100
    base_name: str = ""
    dist_graph_name: str = ""
    tsv_name: str = ""
    barcode_counts: str = ""
    dist_tsv: str = ""
    samples_tsv: str = ""
    output_pair: bool = False
    kmer_mode: bool = False
    inputs: tuple[str, ...] = ()

    def __post_init__(self):
        if not 0 < self.error_percent < 1:
            raise ValueError("error_percent lies between 0 and 1")
        if self.k_value <= 3:
            raise ValueError("k_value must be over 3")
        if self.min_mult > self.max_mult:
            raise ValueError("the multiplicity range is empty")
        if self.dist_mode not in ("median", "upper"):
            raise ValueError("dist_mode is median or upper")
        if self.dist_bin_size < 1 or self.end_length < 0:
            raise ValueError("dist_bin_size is 1 at least, end_length 0 at least")

    @property
    def z(self) -> float:
        """The normal quantile of the one-sided significance test."""
        return NormalDist().inv_cdf(1 - self.error_percent)

    def named(self) -> "ScaffoldParams":
        """With the output names that follow from the base name."""
        base = self.base_name or (
            f"{self.file}.scaff_s{self.seq_id}_c{self.min_reads}_l{self.min_links}_d{self.max_degree}"
            f"_e{self.end_length}_r{self.error_percent:g}"
        )
        return replace(
            self, base_name=base, dist_graph_name=self.dist_graph_name or f"{base}.dist.gv", tsv_name=self.tsv_name or f"{base}_main.tsv"
        )

    @classmethod
    def from_args(cls, args: list[str]) -> "ScaffoldParams":
        kinds = {f.name: type(f.default) for f in fields(cls)}
        values: dict = {}
        inputs: list[str] = []
        rest = list(args)
        while rest:
            arg = rest.pop(0)
            name, eq, inline = arg.partition("=") if arg.startswith("--") else (arg, "", "")
            if name in _FLAGS:
                key, value = _FLAGS[name]
                values[key] = value
            elif name in ("-m", "--index_multiplicity"):
                low, _, high = (inline if eq else rest.pop(0)).partition("-")
                values |= {"min_mult": int(low), "max_mult": int(high)}
            elif name in _OPTIONS:
                key = _OPTIONS[name]
                values[key] = kinds[key](inline if eq else rest.pop(0))
            elif arg.startswith("-") and name not in ("--bx", "-v", "-t", "--threads"):
                raise ValueError(f"unknown option {arg}")
            elif name in ("-t", "--threads") and not eq:
                rest.pop(0)
            elif not arg.startswith("-"):
                inputs.append(arg)
        given = set(values)
        if values.get("kmer_mode") and "seq_id" in given:
            raise ValueError("seq_id belongs to the alignment mode")
        if not values.get("kmer_mode") and given & {"k_value", "j_index"}:
            raise ValueError("k_value and j_index belong to the k-mer mode")
        if values.get("kmer_mode") and not values.get("file"):
            raise ValueError("the k-mer mode needs a contig file")
        return cls(**values, inputs=tuple(inputs))
