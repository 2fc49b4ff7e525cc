from conftest import day, ids

from voucherlens import schema as S
from voucherlens.operators import flags, rules
from voucherlens.plans import audit


def test_every_member_of_a_duplicate_group_is_flagged(invoices):
    same = dict(amount=50, invoice_date=day(0))
    inv = invoices(same, same, same, dict(amount=50, invoice_date=day(1)), dict(vendor_id=2, **same))
    assert [r.occurrences for r in rules.duplicate_groups(inv).collect()] == [3]
    found = rules.detect_duplicates(inv)
    assert ids(found) == ["I000", "I001", "I002"]
    assert {(r.flag_type, r.severity) for r in found.collect()} == {("DUPLICATE", "MEDIUM")}


def test_null_vendor_is_a_group_but_not_a_duplicate(invoices, vendors, stage):
    row = dict(vendor_id=None, amount=50, invoice_date=day(0))
    inv = invoices(row, row)
    assert rules.duplicate_groups(inv).count() == 1
    assert rules.detect_duplicates(inv).count() == 0
    assert audit.validate(inv, vendors((1, "07")), stage).where("is_duplicate").count() == 0


def test_duplicates_equal_the_in_subquery(spark, invoices):
    inv = invoices(*[dict(vendor_id=i % 3, amount=i % 4, invoice_date=day(i % 2)) for i in range(40)])
    inv.createOrReplaceTempView("inv_in")
    want = spark.sql("""
        SELECT invoice_id FROM inv_in WHERE (vendor_id, amount, invoice_date) IN
          (SELECT vendor_id, amount, invoice_date FROM inv_in
           GROUP BY vendor_id, amount, invoice_date HAVING count(*) > 1)""")
    assert ids(rules.detect_duplicates(inv)) == ids(want)


def test_duplicate_keys_can_be_chosen(invoices):
    inv = invoices(dict(amount=1), dict(amount=1), dict(amount=2))
    assert ids(rules.detect_duplicates(inv, ["vendor_id", "amount"])) == ["I000", "I001"]


def test_state_mismatch(invoices, vendors):
    inv = invoices(dict(state_code="07"), dict(state_code="09"), dict(vendor_id=9, state_code="09"),
                   dict(vendor_id=None, state_code="09"), dict(state_code=None))
    assert ids(rules.detect_mismatch(inv, vendors((1, "07")))) == ["I001"]
    marked = rules.mark_mismatch(inv, vendors((1, "07")))
    assert ids(marked.where("is_mismatch")) == ["I001"]
    assert marked.where("is_mismatch IS NULL").count() == 0


def test_invalid_amount(invoices):
    inv = invoices(dict(amount=0), dict(amount=-1), dict(amount=0.01), dict(tax_claimed=-0.01),
                   dict(tax_claimed=0), dict(amount=None))
    assert ids(rules.detect_invalid_amount(inv)) == ["I000", "I001", "I003"]


def test_missing_fields_are_reported_and_not_flagged(invoices, vendors, stage):
    inv = invoices(dict(), dict(vendor_id=None), dict(amount=None), dict(vendor_id=None, amount=None))
    row = rules.missing_field_report(inv).first()
    assert (row.total_invoices, row.missing_any, row.missing_vendor_id, row.missing_amount,
            row.missing_invoice_id, row.missing_invoice_date) == (4, 3, 2, 2, 0, 0)
    assert audit.validate(inv, vendors((1, "07")), stage).where(
        "validation_status = 'FLAGGED'").count() == 0


def test_column_and_table_form_of_the_rules_agree(invoices, vendors, stage):
    inv = invoices(*[dict(vendor_id=i % 3 or None, amount=(i % 5) - 1, invoice_date=day(i % 4),
                          state_code="07" if i % 7 else "09") for i in range(60)])
    ven = vendors((1, "07"), (2, "09"))
    validated = audit.validate(inv, ven, stage)
    table = flags.union_flags(rules.detect_duplicates(inv), rules.detect_mismatch(inv, ven),
                              rules.detect_invalid_amount(inv))
    by_mark = flags.flag_table(validated.withColumn("flags", rules.rule_flags()))
    assert sorted(by_mark.collect(), key=str) == sorted(table.collect(), key=str)
    assert table.count() > 20
    by_column = validated.select("invoice_id", "validation_status")
    by_table = flags.with_status(inv, table).select("invoice_id", "validation_status")
    assert sorted(by_column.collect()) == sorted(by_table.collect())


def test_attach_flags_restores_the_column_and_ignores_repeats(invoices, vendors, stage):
    inv = invoices(dict(amount=-1, state_code="09"), dict(), dict(amount=-2))
    validated = audit.validate(inv, vendors((1, "07")), stage).withColumn(
        "flags", rules.rule_flags())
    table = flags.flag_table(validated)
    again = flags.attach_flags(inv, table.unionByName(table))
    key = lambda r: r.invoice_id

    def shape(df):
        return [(r.invoice_id, r.validation_status, sorted(f.flag_type for f in r.flags))
                for r in sorted(df.collect(), key=key)]
    assert shape(again) == shape(validated)
    assert again.schema["flags"].dataType.elementType.names == S.FLAG.names
