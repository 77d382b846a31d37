import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tariffscope import schemas  # noqa: E402
from tariffscope.session import local_session  # noqa: E402
from tariffscope.sources.tables import AuditTables  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sample():
    return "/root/testdata/sf0.001"


@pytest.fixture
def make(spark):
    """Frame of a declared table from partial dict rows; other columns are null."""

    def build(table, rows):
        schema = schemas.TABLES[table]
        filled = [tuple(row.get(f.name) for f in schema) for row in rows]
        return spark.createDataFrame(filled, schema)

    return build


@pytest.fixture
def small_tables(make):
    """Two clients, three accounts (one without a property); bills are given by the test."""

    def build(bills, line_items=()):
        return AuditTables(
            clients=make("clients", [
                {"client_id": 1, "client_name": "Alma Clinic", "industry": "Healthcare", "is_active": True},
                {"client_id": 2, "client_name": "Bolt Works", "industry": "Manufacturing", "is_active": True},
                {"client_id": 3, "client_name": "Empty Co", "industry": None, "is_active": True},
            ]),
            properties=make("properties", [
                {"property_id": 10, "client_id": 1, "address": "1 Elm", "property_name": "Main"},
                {"property_id": 20, "client_id": 2, "address": "2 Oak", "property_name": "Plant"},
            ]),
            vendors=make("vendors", [{"vendor_id": 1, "vendor_name": "Volt", "vendor_type": "Electric"}]),
            accounts=make("accounts", [
                {"account_id": 100, "property_id": 10, "vendor_id": 1, "account_number": "00000100"},
                {"account_id": 200, "property_id": 20, "vendor_id": 1, "account_number": "00000200"},
                {"account_id": 300, "property_id": None, "vendor_id": 1, "account_number": "00000300"},
            ]),
            bills=make("bills", bills),
            line_items=make("line_items", list(line_items)),
        )

    return build
