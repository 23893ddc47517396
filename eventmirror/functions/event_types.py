"""Event types, object types and what belongs to what."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Event types that are listed one by one, by object type.
EXACT = {
    "customer": ("customer.created", "customer.updated", "customer.deleted"),
    "product": ("product.created", "product.updated", "product.deleted"),
    "price": ("price.created", "price.updated", "price.deleted"),
    "charge": ("charge.succeeded", "charge.failed", "charge.refunded", "charge.updated", "charge.captured", "charge.expired"),
    "refund": ("charge.refund.updated", "refund.created", "refund.updated", "refund.failed"),
    "payment_method": ("payment_method.attached", "payment_method.updated", "payment_method.automatically_updated", "payment_method.detached"),
    "checkout_session": (
        "checkout.session.completed", "checkout.session.expired",
        "checkout.session.async_payment_succeeded", "checkout.session.async_payment_failed",
    ),
}
# Families that match by prefix, with the members that can be asked for by name.
FAMILIES = {
    "subscription": ("customer.subscription.", ("created", "deleted", "paused", "resumed", "trial_will_end", "updated")),
    "invoice": (
        "invoice.",
        ("created", "deleted", "finalized", "marked_uncollectible", "paid", "payment_action_required", "payment_failed", "payment_succeeded", "sent", "updated", "voided"),
    ),
    "dispute": ("charge.dispute.", ("closed", "created", "funds_reinstated", "funds_withdrawn", "updated")),
    "payment_intent": (
        "payment_intent.",
        ("amount_capturable_updated", "canceled", "created", "partially_funded", "payment_failed", "processing", "requires_action", "succeeded"),
    ),
    "setup_intent": ("setup_intent.", ("canceled", "created", "requires_action", "setup_failed", "succeeded")),
}
#: Parents before children; payment methods after the subscriptions that select them.
BACKFILL_TYPES = (
    "product", "price", "customer", "subscription", "payment_method", "invoice", "charge",
    "payment_intent", "setup_intent", "refund", "dispute", "checkout_session",
)
#: Payment methods cannot be listed for a whole account; items are compared within their subscription.
VERIFY_TYPES = tuple(t for t in BACKFILL_TYPES if t != "payment_method")
OBJECT_TYPES = (*BACKFILL_TYPES, "subscription_item")


def resolve_type(event_type: Column) -> Column:
    """The object type that an event type is about, or null: exact names first, then families."""
    names = F.create_map(*[F.lit(x) for kind, types in EXACT.items() for t in types for x in (t, kind)])
    family = F.coalesce(*[F.when(F.startswith(event_type, F.lit(prefix)), F.lit(kind)) for kind, (prefix, _) in FAMILIES.items()])
    return F.coalesce(F.try_element_at(names, event_type), family)


def subscribed_types() -> list[str]:
    """The exact event types to ask upstream for, sorted. New members of a family resolve, but are not among them."""
    exact = [t for types in EXACT.values() for t in types]
    return sorted(exact + [prefix + name for prefix, names in FAMILIES.values() for name in names])


def plan(types: Iterable[str] | None = None, allowed: tuple[str, ...] = BACKFILL_TYPES) -> list[str]:
    """The asked-for types in dependency order; all of them if none is named."""
    asked = set(types or allowed)
    if unknown := sorted(asked - set(allowed)):
        raise ValueError(f"not possible for {', '.join(unknown)}; one of {', '.join(allowed)}")
    return [t for t in allowed if t in asked]
