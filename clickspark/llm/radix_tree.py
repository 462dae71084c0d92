"""An adaptive radix tree over byte strings: node layouts that grow with their children, compressed paths."""

from __future__ import annotations

from collections.abc import Iterator

LAYOUTS = (4, 16, 48, 256)
_NONE = 255  # no place in the index of a 48-child layout


class Node:
    """A node with the bytes every key below shares (``prefix``, after the byte that leads here), the
    values of keys that end here (``ends``, and the ``key`` itself), and children by their next byte.
    ``total`` is for who walks the tree.

    Layouts of 4 and 16 children keep sorted key bytes beside the children, 48 an index of 256 bytes into
    them, 256 one slot per byte.
    """

    __slots__ = ("ends", "key", "keys", "kids", "layout", "prefix", "total")

    def __init__(self, prefix: bytes):
        self.prefix, self.ends, self.key, self.layout, self.total = prefix, [], b"", 4, None
        self.keys: bytearray = bytearray()
        self.kids: list[Node | None] = []

    def child(self, byte: int) -> Node | None:
        if self.layout <= 16:
            at = self.keys.find(byte)
            return self.kids[at] if at >= 0 else None
        if self.layout == 48:
            at = self.keys[byte]
            return self.kids[at] if at != _NONE else None
        return self.kids[byte]

    def set_child(self, byte: int, node: Node) -> None:
        """Put ``node`` under ``byte``; a full layout grows to the next."""
        if self.layout <= 16:
            at = self.keys.find(byte)
            if at >= 0:
                self.kids[at] = node
                return
            if len(self.kids) < self.layout:
                at = sum(k < byte for k in self.keys)
                self.keys.insert(at, byte)
                self.kids.insert(at, node)
                return
        elif self.layout == 48:
            at = self.keys[byte]
            if at != _NONE:
                self.kids[at] = node
                return
            if len(self.kids) < 48:
                self.keys[byte] = len(self.kids)
                self.kids.append(node)
                return
        else:
            self.kids[byte] = node
            return
        self._grow()
        self.set_child(byte, node)

    def _grow(self) -> None:
        held = list(self.children())
        self.layout = LAYOUTS[LAYOUTS.index(self.layout) + 1]
        if self.layout == 48:
            self.keys = bytearray([_NONE]) * 256
            for at, (byte, _) in enumerate(held):
                self.keys[byte] = at
            self.kids = [kid for _, kid in held]
        elif self.layout == 256:
            self.keys, self.kids = bytearray(), [None] * 256
            for byte, kid in held:
                self.kids[byte] = kid

    def children(self) -> Iterator[tuple[int, Node]]:
        """(byte, child) in the order of the bytes."""
        if self.layout <= 16:
            yield from zip(self.keys, self.kids, strict=True)
        elif self.layout == 48:
            yield from ((byte, self.kids[at]) for byte, at in enumerate(self.keys) if at != _NONE)
        else:
            yield from ((byte, kid) for byte, kid in enumerate(self.kids) if kid is not None)


def shared_length(a: bytes, b: bytes) -> int:
    """Leading bytes that ``a`` and ``b`` have in common, found by halving."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while low < high - 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


class RadixTree:
    """Values by byte-string keys; a key may be a prefix of another and may come any number of times."""

    def __init__(self) -> None:
        self.root: Node | None = None

    def insert(self, key: bytes, value: object) -> None:
        if self.root is None:
            self.root = Node(key)
        above, byte, node, at = None, 0, self.root, 0
        while True:
            rest = key[at:at + len(node.prefix)]
            if rest != node.prefix:
                node = self._split(above, byte, node, shared_length(rest, node.prefix))
            at += len(node.prefix)
            if at == len(key):
                node.ends.append(value)
                node.key = key
                return
            above, byte = node, key[at]
            at += 1
            kid = node.child(byte)
            if kid is None:
                kid = Node(key[at:])
                node.set_child(byte, kid)
            node = kid

    def _split(self, above: Node | None, byte: int, node: Node, length: int) -> Node:
        """Cut ``node``'s path after ``length`` bytes; returns the new node that ends there."""
        upper = Node(node.prefix[:length])
        upper.set_child(node.prefix[length], node)
        node.prefix = node.prefix[length + 1:]
        if above is None:
            self.root = upper
        else:
            above.set_child(byte, upper)
        return upper
