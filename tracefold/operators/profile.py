"""The vocabulary of a corpus: labels in front of values, and shared mailboxes. A JSON file adds to it."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, fields

# Labels and mailboxes that decide which values are found.
NAME_LABELS = [
    "patient", "employee", "claimant", "customer", "contact", "to", "bill to", "name", "full name", "legal name", "full legal name", "beneficiary", "beneficiary name",
    "beneficiary full legal name", "account holder", "policy holder", "policyholder", "insured", "member", "member name", "client", "applicant", "recipient", "subject",
    "individual", "person", "cardholder", "borrower", "tenant", "resident", "guardian", "next of kin", "patient of record", "in the matter of", "in re", "relates to",
    "on behalf of", "prepared for", "issued to", "statement for", "record for", "file for", "regarding", "concerning", "with respect to", "best", "best regards",
    "kind regards", "regards", "sincerely", "many thanks", "thanks", "yours", "yours sincerely", "yours faithfully",
]
ADDRESS_LABELS = ["home address", "mailing address", "shipping address", "address", "residential address", "street address", "postal address", "billing address", "notices shall be sent to", "residence", "domicile", "location", "address on file", "current address", "permanent address"]
ACCOUNT_LABELS = ["account", "account number", "bank account", "acct", "acct no", "account no", "iban", "sort code", "routing", "routing number", "payment instrument", "primary payment instrument", "deposit account"]
LOGIN_LABELS = ["username", "user name", "login", "logon", "user id", "userid", "screen name", "handle", "account name", "provisioned as", "created as", "issued as", "registered as", "set up as", "logs in as", "signs in as", "authenticates as", "network account", "system account", "domain account", "account id"]
SHARED_MAILBOXES = ["support", "info", "sales", "help", "helpdesk", "admin", "administrator", "contact", "enquiries", "inquiries", "noreply", "no-reply", "donotreply", "postmaster", "webmaster", "hr", "payroll", "billing", "accounts", "legal", "compliance", "privacy", "security", "abuse", "records", "team", "office", "mail", "general"]


@dataclass(frozen=True)
class Profile:
    name_labels: tuple[str, ...] = tuple(NAME_LABELS)
    address_labels: tuple[str, ...] = tuple(ADDRESS_LABELS)
    account_labels: tuple[str, ...] = tuple(ACCOUNT_LABELS)
    login_labels: tuple[str, ...] = tuple(LOGIN_LABELS)
    shared_mailboxes: tuple[str, ...] = tuple(SHARED_MAILBOXES)

    @classmethod
    def load(cls, path: str | None = None) -> Profile:
        """C20: the defaults, and behind them what the JSON file (or the file named by CORPUS_PROFILE) adds."""
        path = path or os.environ.get("CORPUS_PROFILE")
        if not path or not os.path.exists(path):
            return cls()
        with open(path, encoding="utf-8") as f:
            return cls.parse(f.read())

    @classmethod
    def parse(cls, text: str) -> Profile:
        """C20: the defaults, and behind them what a JSON text adds; what is there already is not added again."""
        base, more = cls(), json.loads(text)
        return cls(**{x.name: tuple(dict.fromkeys([*getattr(base, x.name), *more.get(x.name, [])])) for x in fields(cls)})

    @property
    def label_words(self) -> list[str]:
        """All labels in lower case."""
        return sorted({w.lower() for w in (*self.name_labels, *self.address_labels, *self.account_labels, *self.login_labels)})


def alternation(labels: tuple[str, ...] | list[str]) -> str:
    """The labels as one pattern, longest first."""
    return "|".join(re.escape(x) for x in sorted(labels, key=len, reverse=True))
