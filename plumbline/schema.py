"""Feature schemas: a width and, optionally, ordered unique names; identity by a fingerprint."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from plumbline.errors import DataError, SchemaError

#: Prefixes of the fingerprinted bytes and of the printed fingerprint; parameters of the format.
NAMESPACE = ("plumbline-feature-schema-v1", "plumbline-schema-v1")


@dataclass(frozen=True)
class FeatureSchema:
    """``names`` None: anonymous. An anonymous schema never equals a named one."""

    width: int
    names: tuple[str, ...] | None = None

    def __post_init__(self) -> None:
        if self.width < 0:
            raise DataError("negative dimension", f"a schema has no {self.width} features", value=self.width)
        if self.names is None:
            return
        if len(self.names) != self.width:
            raise DataError("length mismatch", f"{len(self.names)} names for {self.width} features",
                            expected=self.width, observed=len(self.names))
        seen: dict[str, int] = {}
        for i, name in enumerate(self.names):
            if not name:
                raise DataError("empty feature name", f"feature name {i} is empty", index=i)
            if name in seen:
                raise DataError("duplicate feature name", f"feature name {name!r} at {i} repeats that at {seen[name]}",
                                name=name, first_index=seen[name], duplicate_index=i)
            seen[name] = i

    @classmethod
    def named(cls, names: Iterable[str]) -> FeatureSchema:
        names = tuple(names)
        return cls(len(names), names)

    @classmethod
    def anonymous(cls, width: int) -> FeatureSchema:
        return cls(width)

    def fingerprint(self, namespace: tuple[str, str] = NAMESPACE) -> str:
        """MD5 over the namespace, the width, a flag for names, and each name with its length."""
        data = namespace[0].encode() + struct.pack(">qB", self.width, self.names is not None)
        for name in self.names or ():
            raw = name.encode()
            data += struct.pack(">q", len(raw)) + raw
        return f"{namespace[1]}:{hashlib.md5(data).hexdigest()}"

    def subset(self, indices: Sequence[int]) -> FeatureSchema:
        """The features at ``indices``, in that order, with their names."""
        for i in indices:
            if not 0 <= i < self.width:
                raise DataError("index out of bounds", f"feature {i} of {self.width}", index=i, upper_bound=self.width)
        return FeatureSchema(len(indices), None if self.names is None else tuple(self.names[i] for i in indices))

    def require(self, other: FeatureSchema, where: str) -> None:
        """Fail unless ``other`` is this schema; no job."""
        if self != other:
            raise SchemaError(f"{where}: the features differ from those of fitting",
                              "pass the features in the order of fitting", expected=self, observed=other)
