"""Client of the sector server's protocol: protobuf messages ended by one zero byte."""

from __future__ import annotations

import socket

# Message types.
OPEN, CLOSE, READ, SIZE = 1, 2, 3, 4
MOST_BYTES = (1 << 20) + 1024


def varint(value: int) -> bytes:
    value &= (1 << 64) - 1
    out = bytearray()
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    out.append(value)
    return bytes(out)


def request(kind: int, offset: int | None = None, count: int | None = None) -> bytes:
    fields = b"\x08" + varint(kind)
    for tag, value in ((b"\x10", offset), (b"\x18", count)):
        if value is not None:
            fields += tag + varint(value)
    return fields + b"\x00"


#: Bytes of fields of a fixed size, by wire type.
FIXED = {1: 8, 5: 4}


def response(message: bytes) -> tuple[int, int, bytes] | None:
    """Type, result and data of a message; null if these bytes aren't a whole one.

    Fields that aren't known are passed over.
    """
    known: dict[int, int | bytes] = {1: 0, 2: 0, 3: b""}
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            value |= (message[at] & 0x7F) << shift
            at += 1
            if message[at - 1] < 0x80:
                return value
            shift += 7

    try:
        while at < len(message):
            key = number()
            tag, wire = key >> 3, key & 7
            if wire == 0:
                value: int | bytes = number()
            elif wire == 2 or wire in FIXED:
                size = number() if wire == 2 else FIXED[wire]
                value, at = message[at : at + size], at + size
                if at > len(message):
                    return None
            else:
                return None
            if tag in known and isinstance(value, type(known[tag])):
                known[tag] = value
    except IndexError:
        return None
    kind, result, data = known.values()
    return kind, result - (1 << 64) if result >> 63 else result, data


class Session:
    """One opened drive; closed at the end, whatever happens."""

    def __init__(self, address: tuple[str, int]) -> None:
        self.socket = socket.create_connection(address)
        self.socket.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)

    def __enter__(self) -> Session:
        kind, result, _ = self.ask(request(OPEN))
        if kind != OPEN or result != 0:
            self.socket.close()
            raise OSError(f"the drive can't be opened: type {kind}, result {result}")
        return self

    def __exit__(self, *_) -> None:
        try:
            self.ask(request(CLOSE))
        except OSError:
            pass
        finally:
            self.socket.close()

    def ask(self, message: bytes) -> tuple[int, int, bytes]:
        self.socket.sendall(message)
        got = bytearray()
        while True:
            more = self.socket.recv(1 << 16)
            if not more:
                raise OSError("the server hung up")
            got += more
            # A zero at the end may also be one of the data's.
            if got[-1] == 0 and (found := response(bytes(got[:-1]))) is not None:
                return found
            if len(got) > MOST_BYTES:
                raise OSError(f"a message of more than {MOST_BYTES} bytes")

    def sectors(self) -> int:
        kind, result, _ = self.ask(request(SIZE))
        if kind != SIZE:
            raise OSError(f"no size but type {kind}")
        return result & 0xFFFFFFFF

    def read(self, offset: int, count: int) -> bytes:
        kind, result, data = self.ask(request(READ, offset, count))
        if kind != READ or result < 0 or len(data) != result * 2048:
            raise OSError(f"bad sectors from {offset}: type {kind}, result {result}, {len(data)} bytes")
        return data
