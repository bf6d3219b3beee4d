"""Course details and degree audits from pages: literal rows, and pages made from tables against their SQL."""

import datetime
import random

from termloom.queries import pages
from termloom.sources import course_pages

COURSE = """<html><head><style>td { x: 1 }</style><script>"<tr><td>99</td></tr>"</script></head><body>
<p>04000201-62 English for Engineering ภาษาอังกฤษ สำหรับงาน สังกัด คณะวิศวกรรมศาสตร์ หน่วยกิต 3(2-2-5) สถานะรายวิชา : เปิด เลือก ปีการศึกษา : 1 / 2569</p>
<table><tr><th>กลุ่ม</th></tr><tr><td colspan=9>ระดับ 20: ปริญญาตรี ภาคปกติ</td></tr>
<tr><td>2<td>เสาร์<td>13:00-15:00<td>N/A<td>C<td>29 26 3<td>W
<tr><td></td><td>ส.</td><td>15:00 - 17:00</td><td>R1</td><td>B2</td><td>L</td></tr>
<tr><td>อา</td><td>no time</td></tr>
<tr><td></td><td>อาจารย์: A. One, Two / Three สำรอง สำหรับ วศ. ปี 3 สอบกลางภาค: 5 ก.ย. 2569 เวลา 09:00 - 12:00 อาคาร A ห้อง 7 หมายเหตุ: n1</td></tr>
<tr><td></td><td>อาจารย์: Other สอบปลาย ภาค: 1 ธันวาคม 2569 หมายเหตุ: n2</td></tr>
<tr><td>ระดับ 21: ภาคพิเศษ</td></tr>
<tr><td>3</td><td>จ.</td><td>9:00-10:00</td><td><table><tr><td>inner</td></tr></table></td></tr></table></body></html>"""

AUDIT = """<table><tr><td>165404000001-2 Some One ตรวจสอบจบ จำนวนหน่วยกิตขั้นต่ำ : 20 ปีสูงสุด : 8 GPAX ต่ำสุด : 2.00</td></tr>
<tr><td>12345678-62</td><td>before any category</td><td>3</td></tr>
<tr><td>รวม</td><td>หน่วยกิตที่ผ่าน : {grand} GPA เฉลี่ย : 2.55</td></tr>
<tr><td>1 General หน่วยกิตต่ำสุด : 7 หน่วยกิตสูงสุด : - GPAX ต่ำสุด : 0.00</td></tr>
<tr><td>1.1 Social</td><td>หน่วยกิตต่ำสุด : 3</td></tr>
<tr><td>04000201-62</td><td>English</td><td>3(2-2-5)</td><td>1/66</td><td>2/66</td><td></td><td></td><td></td><td>F</td><td>B+</td><td></td><td></td><td></td><td>2.5</td><td>3.0</td></tr>
<tr><td>C0400011</td><td>Skill</td><td>1</td><td>3/66</td><td>ไม่สอบ</td></tr>
<tr><td>04000202-62</td><td>Open</td><td>x</td></tr>
<tr><td>รวม</td><td>หน่วยกิตที่ผ่าน : {sub}</td><td><input type=checkbox>ผ่าน <input type=CHECKBOX checked>ไม่ผ่าน</td><td>หน่วยกิตต่ำกว่าเกณฑ์</td></tr>
<tr><td>2 Core</td><td>หน่วยกิตต่ำสุด : 6</td></tr>
<tr><td>รวม</td><td>หน่วยกิตที่ผ่าน : {core} ☑ ผ่าน</td></tr></table>"""


def test_course_detail(spark):
    rows = [(1, COURSE), (2, None), (3, "<p>nothing"), (1, COURSE)]
    got = sorted(course_pages.course_details(spark.createDataFrame(rows, "id long, html string"), "id", "html").collect(), key=lambda r: r["id"])
    assert [r["id"] for r in got] == [1, 1, 2, 3] and got[0] == got[1]
    c = got[0]
    assert (c["course_code"], c["name_en"], c["name_th"], c["faculty"], c["status"], c["term"]) == ("04000201-62", "English for Engineering", "ภาษาอังกฤษ สำหรับงาน", "คณะวิศวกรรมศาสตร์", "เปิด", "1/2569")
    assert tuple(c["credit"]) == (3, 2, 2, 5)
    a, b = c["sections"]
    assert (a["section"], a["level"], a["seat_total"], a["seat_taken"], a["seat_left"], a["status"]) == ("02", "ระดับ 20: ปริญญาตรี ภาคปกติ", 29, 26, 3, "W")
    assert [tuple(m) for m in a["meetings"]] == [(5, "เสาร์", 780, 900, "N/A", "", "C"), (5, "ส.", 900, 1020, "R1", "B2", "L")]
    assert a["teachers"] == ["A. One", "Two", "Three"] and a["reserved_for"] == "วศ. ปี 3" and a["note"] == "n1"
    assert tuple(a["midterm"]) == (datetime.date(2026, 9, 5), 540, 720, "A", "7")
    assert tuple(a["final"]) == (datetime.date(2026, 12, 1), None, None, "", "")
    assert (b["section"], b["level"], b["teachers"], b["midterm"]) == ("03", "ระดับ 21: ภาคพิเศษ", [], None)
    assert [(m["day"], m["start_min"], m["room"]) for m in b["meetings"]] == [(0, 540, "inner")]
    assert got[2]["sections"] == got[3]["sections"] == [] and got[3]["course_code"] == ""


def test_degree_audit(spark):
    rows = [(1, AUDIT.format(grand=12, sub=3, core=5)), (2, AUDIT.format(grand="-", sub=3, core=5)), (3, AUDIT.format(grand="-", sub="-", core="-")), (4, None)]
    got = {r["id"]: r for r in course_pages.degree_audits(spark.createDataFrame(rows, "id int, html string"), "id", "html").collect()}
    a = got[1]
    assert (a["student_id"], a["student_name"], a["min_total_credits"], a["max_years"], a["min_gpax"], a["gpa"]) == ("165404000001-2", "Some One", 20, 8, 2.0, 2.55)
    assert [(got[i]["total_passed_credits"], got[i]["earned_credits"], got[i]["remaining_credits"]) for i in (1, 2, 3)] == [(12, 12, 8), (None, 5, 15), (None, 3, 17)]
    one, social, core = a["categories"]
    assert (one["number"], one["name"], one["depth"], one["parent"], one["min_credits"], one["max_credits"], one["min_gpax"], one["remaining_credits"], one["is_passed"]) == ("1", "General", 1, None, 7, None, 0.0, 7, None)
    assert (social["number"], social["name"], social["depth"], social["parent"], social["passed_credits"], social["is_passed"], social["below_min"], social["remaining_credits"]) == ("1.1", "Social", 2, "1", 3, False, True, 0)
    assert (core["is_passed"], core["below_min"], core["remaining_credits"], core["courses"]) == (True, False, 1, [])
    english, skill, other = social["courses"]
    assert (english["code"], english["credits"], english["average"], english["final"], english["passed"]) == ("04000201-62", 3, 2.5, 3.0, True)
    assert [tuple(t) for t in english["attempts"]] == [("1/2566", "F"), ("2/2566", "B+")]
    assert ([tuple(t) for t in skill["attempts"]], skill["credits"], skill["passed"]) == ([("3/2566", "ไม่สอบ")], 1, False)
    assert (other["attempts"], other["credits"], other["passed"], other["average"]) == ([], 0, False, None)
    assert got[4]["categories"] == [] and got[4]["min_total_credits"] is None and got[4]["remaining_credits"] is None


def test_plain_pages_are_read_as_by_the_parser():
    dice = random.Random(5)
    parts = ["<table>", "</table>", "<tr>", "</tr>", "<td>", "</td>", "<th>", "<p>", "</p>", "<input>", "a b", " ", "\n", "ก", ">", "x > y"]
    odd = ["&amp;", "&lt", "<", "<br/>", "<td colspan=2>", "<TD>", "<!-- <td> -->", "<script>", "</script>", "<title>", "</title>", "<input type=checkbox checked>", "</", "<1>"]
    seen = lambda page: (page.text, [(r.cells, r.text, r.boxes) for r in page.rows])
    for n in range(3000):
        html = "".join(dice.choice(parts if n % 2 or dice.random() < 0.9 else odd) for _ in range(dice.randrange(40)))
        got, want = course_pages._Page(), course_pages._Page()
        got.read(html)
        want.feed(html)
        want.close()
        assert seen(got) == seen(want), html


def test_plain_pages_do_not_need_the_parser(monkeypatch):
    monkeypatch.setattr(course_pages._Page, "feed", None)
    page = course_pages._Page()
    page.read("<table><tr><td>1</td><td>2 3</td></tr></table>")
    assert [r.cells for r in page.rows] == [[["1"], ["2 3"]]]


def test_rows_carry_no_course(spark):
    """The course of a page moves with its first row, and a section's rows are collected once."""
    planned = pages.course_sections(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert planned.count("collect_list(struct(position") == 1
