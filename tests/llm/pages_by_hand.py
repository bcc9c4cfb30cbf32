"""Pages written by hand after the layouts of common site builders, none of
which the training pages were made from. Lines that start with ``+`` are
content; the marker is not part of the page."""

PAGES = {
    "blog engine": """
<body class="home wp-singular"><a class="skip-link" href="#c">Skip to content</a>
<header id="site-header"><p class="site-title"><a href="/">Notes from the Harbour</a></p><p class="tagline">A journal of small boats.</p></header>
<div id="primary" class="content-area"><main id="main-content"><article id="post-311" class="post type-post hentry">
+<h1 class="entry-title">Caulking an old dinghy</h1>
<div class="entry-content">
+<p>The seams had opened over the winter, and by April you could see daylight through the garboard.</p>
+<p>I used cotton first, then a <a href="/putty">putty</a> that sets slowly. It took three evenings.</p>
+<ul><li>Cotton, two hanks</li>
+<li>Putty, one tin</li></ul>
+<blockquote><p>A boat is never finished, only launched.</p></blockquote>
</div></article>
<div id="comments" class="comments-area"><h2>Two thoughts on this</h2><ol class="comment-list"><li><div class="comment-body"><p>My uncle used tar for that, and it lasted ten years.</p></div></li></ol>
<div id="respond"><form><p>Leave a reply. Your address will not be published.</p><label>Name</label></form></div></div></main></div>
<aside id="secondary" class="widget-area"><section class="widget"><h2>Recent posts</h2><ul><li><a href="/a">Sails in storage</a></li><li><a href="/b">A new mast</a></li></ul></section></aside>
<footer id="colophon">Proudly powered by nothing in particular.</footer></body>""",
    "news site": """
<body><div class="consent-overlay"><p>We and our partners store information on your device. You may refuse.</p></div>
<div class="topbar"><nav><a href="/w">World</a><a href="/b">Business</a><a href="/s">Sport</a></nav></div>
<div class="story-page"><section class="story-body">
+<h1>Council votes to keep the night trams</h1>
<div class="share-tools"><a href="#">Share</a><a href="#">Print</a></div>
+<p>The city council decided on Tuesday evening, by a narrow vote, to keep the trams running after midnight.</p>
<div class="ad-slot">Advertisement</div>
+<p>Opponents had argued that the cost, about two million a year, was too high for so few riders.</p>
+<h2>What happens next</h2>
+<p>The timetable will be reviewed in the spring, the mayor said, and drivers will be asked for their views.</p>
<div class="related-links"><h3>More on this</h3><ul><li><a href="/1">How the lines grew</a></li><li><a href="/2">Night buses elsewhere</a></li></ul></div>
</section></div><div class="newsletter-signup"><p>Get the morning briefing in your inbox.</p><form><input></form></div>
<footer class="global-footer"><ul><li><a href="/t">Terms</a></li><li><a href="/p">Privacy</a></li></ul><p>Copyright 2023, all rights reserved.</p></footer></body>""",
    "documentation": """
<body><div class="sidebar-tree"><ul><li><a href="/intro">Introduction</a></li><li><a href="/install">Installation</a></li><li><a href="/api">Reference</a></li></ul></div>
<div role="main" class="document"><div class="body">
+<h1>Installing the tool</h1>
+<p>The tool needs a recent interpreter and nothing else. Download the archive, unpack it, and run the script.</p>
+<pre>tar xf tool.tar.gz
cd tool
./setup</pre>
+<h2>Troubleshooting</h2>
+<p>If the script stops with an error about permissions, make it executable and start it again.</p>
+<table><tr><td>Exit code 1</td>
+<td>The archive is damaged</td></tr></table>
</div></div><div class="prev-next pagination"><a href="/intro">Previous: Introduction</a> <a href="/api">Next: Reference</a></div>
<footer>Built with a generator. <a href="/src">Show source</a></footer></body>""",
    "encyclopedia": """
<body><div id="mw-navigation"><div id="p-logo"></div><div class="portal" role="navigation"><ul><li><a href="/m">Main page</a></li><li><a href="/r">Random article</a></li></ul></div></div>
<div id="content" role="main">
+<h1 id="firstHeading">Lesser tidal mill</h1>
<div id="bodyContent">
+<p>A <b>lesser tidal mill</b> is a water mill driven by the rise and fall of the tide, in use along flat coasts since the twelfth century.</p>
<div id="toc" class="toc"><h2>Contents</h2><ul><li><a href="#h">1 History</a></li><li><a href="#d">2 Design</a></li></ul></div>
+<h2>History</h2>
+<p>The oldest known mill of this kind stood near the mouth of a small river; its foundations were found in 1964.</p>
+<h2>Design</h2>
+<p>A dam with a gate holds the water back at high tide. When the level outside has fallen, the gate is opened and the wheel turns.</p>
</div></div><div id="footer" role="contentinfo"><ul><li>This page was last edited in May.</li><li><a href="/p">Privacy policy</a></li></ul></div></body>""",
    "forum answer": """
<body><div class="topbar"><form id="search"><input placeholder="Search"></form><a href="/login">Log in</a></div>
<div id="mainbar"><div class="question">
+<h1>How do I keep bread from going stale?</h1>
<div class="post-text">
+<p>I bake twice a week, but by the third day the loaf is hard. What is the best way to store it, and does it depend on the flour?</p>
</div></div></div>
<div id="sidebar"><div class="module"><h4>Related</h4><a href="/q1">Freezing dough</a><a href="/q2">Rye or wheat</a></div></div>
<div id="footer" class="footer"><p>site design and logo, all rights reserved</p></div></body>""",
    "plain old page": """
<body bgcolor=white><table width=100%><tr><td width=150 class=menu><a href=a.htm>Home</a><br><a href=b.htm>Pictures</a><br><a href=c.htm>Guestbook</a></td><td>
+<h2>Our trip to the lakes</h2>
+<p>We left early on Saturday, with two tents and far too much food, and reached the first lake before noon.
+<p>It rained all night. In the morning the water was as still as glass, and nobody wanted to leave.
</td></tr></table><hr><div id=footer><a href=mailto:x>Write to us</a></div></body>""",
    "public office": """
<body><div class="banner" role="banner"><a href="/">Office of Weights and Measures</a></div><nav class="breadcrumbs" aria-label="Breadcrumb"><ol><li><a href="/">Home</a></li><li><a href="/g">Guidance</a></li></ol></nav>
<main><div class="grid-row"><div class="column-two-thirds">
+<h1>Apply for a calibration certificate</h1>
+<p>You need a certificate if you sell goods by weight. Apply at least six weeks before you open.</p>
+<h2>What it costs</h2>
+<p>The fee is 40 for each scale, and 15 for each further visit within a year.</p>
</div><div class="column-third"><aside class="related-items" role="complementary"><h2>Related content</h2><ul><li><a href="/x">Find an inspector</a></li></ul></aside></div></div></main>
<div class="feedback-form"><form><p>Is this page useful?</p></form></div><footer role="contentinfo"><a href="/h">Help</a><a href="/c">Cookies</a></footer></body>""",
    "essay": """
<body><div class="wrapper"><div class="header"><a href="/">Longer Thoughts</a></div><div class="text">
+<h1>On waiting</h1>
+<p>There is a kind of waiting that is almost work. You sit at the window, and nothing comes, and yet you are tired in the evening.</p>
+<p>My grandmother knew it well. She said that one should always have a piece of wool at hand.</p>
+<p>I have thought about that sentence for thirty years.</p>
</div><div class="subscribe-box"><p>If you liked this, subscribe. It is free, and I write once a month.</p></div><div class="footer">&copy; The author</div></div></body>""",
}


def page(text: str) -> tuple[str, list[str]]:
    """The page, and the lines of its content."""
    lines = text.strip().split("\n")
    out, content, inside = [], [], False
    for x in lines:
        inside = x.startswith("+") or inside and not x.startswith("<")  # what goes on below a marked line
        out.append(x.removeprefix("+"))
        if inside:
            content.append(x.removeprefix("+"))
    return "<!DOCTYPE html><html><head><title>t</title></head>" + "\n".join(out) + "</html>", content
