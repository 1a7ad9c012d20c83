"""Inputs that several tests use."""

#: An article with sections, a figure within a paragraph, a list, a table, and a section that is met twice.
JATS = """<article xmlns:x="http://www.w3.org/1999/xlink" xml:lang="en">
<front><article-meta>
<article-id pub-id-type="pmc">{n}</article-id><article-id pub-id-type="pmid">{n}1</article-id>
<title-group><article-title>Rivers of valley {n}</article-title></title-group>
<pub-date><year>2021</year></pub-date>
<permissions><license x:href="https://creativecommons.org/licenses/by/4.0/">Open to all</license></permissions>
<abstract><title>Aim</title><p>We mapped <i>every</i> stream.</p></abstract>
</article-meta></front>
<body><sec id="flow"><title>Flow</title>
<p>Gauges of <bold>type</bold> two<fig id="map"><caption><p>The map.</p></caption></fig> were read daily.</p>
<list><list-item><p>{body}</p></list-item></list>
<table-wrap><table><tr><td>low</td><td>high</td></tr></table></table-wrap>
</sec><sec id="flow"><p>Told twice.</p></sec></body>
<back><p>Sources.</p></back></article>"""
