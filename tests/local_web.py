"""A network for tests: names with addresses of their own, all of which lead to one server on this machine."""

import json
import os
import socket

from strataq.sources.fetch import Network

#: Public and private addresses of made-up hosts; a file, as tasks are other processes.
PORT_FILE = os.path.join(os.path.dirname(os.path.abspath(__file__)), ".local_web.json")
NAMES = {"site.test": {"93.184.216.34"}, "other.test": {"2606:2800:220:1::1", "93.184.216.35"}, "inside.test": {"10.0.0.7"}, "both.test": {"93.184.216.34", "127.0.0.1"}, "mapped.test": {"::ffff:169.254.169.254"}, "nowhere.test": set()}


class LocalWeb(Network):
    def addresses(self, host, port):
        return NAMES.get(host) if host in NAMES else super().addresses(host, port)

    def connect(self, address, port, seconds):
        with open(PORT_FILE) as f:
            return socket.create_connection(("127.0.0.1", json.load(f)["port"]), seconds)
