"""The small labelled table that trains the block classifier.

Pages written for this purpose: every element with a ``data-label`` gives the
blocks below it that label; ``main`` is main text, everything else is not.
"""

_NAV = '<nav data-label="menu"><ul><li><a href="/">Home</a></li><li><a href="/news">News</a></li><li><a href="/a">About us</a></li></ul></nav>'
_FOOT = '<footer data-label="footer">&copy; 2024 Example Press. All rights reserved. <a href="/p">Privacy</a></footer>'

PAGES = (
    # semantic article with an advert before it, short and long paragraphs
    f"""<html><body>{_NAV}<div class="ad" data-label="ad">Buy two and get one free today.</div><article data-label="main"><h1>Harbour reopens</h1>
    <p>The harbour reopened on Monday after repairs to the quay that took most of the winter and cost more than was planned.</p><p>Ships came in.</p>
    <p>Fishers said that they had lost a season, and that the town should have asked them before it chose the months for the work.</p></article>{_FOOT}</body></html>""",
    # an advert, a share bar and a newsletter form inside the article
    f"""<html><body>{_NAV}<article><h1 data-label="main">Orchard prices</h1><p data-label="main">Apple prices fell again this week.</p><div class="ad-slot" data-label="ad">Sponsored: fresh juice delivered to your door every single morning, order now and save.</div>
    <p data-label="main">Growers blame a warm spring. <a href="/x">Last year</a> it was frost that did the harm, and nobody had juice to sell at all.</p><div class="share-bar" data-label="share"><a href="#">Share</a> <a href="#">Tweet</a></div>
    <form data-label="form">Your email address <input name="e"> Subscribe to the letter</form><p data-label="main">Markets open at six.</p></article>{_FOOT}</body></html>""",
    # header, sidebar, comments
    f"""<html><body><header data-label="header"><h1>The Daily Example</h1><p>News since 1901, for everyone who lives in the valley and beyond.</p></header>{_NAV}<main data-label="main"><h2>Bridge closed</h2><p>The old bridge is closed to cars until the end of May, the council said in a short statement.</p><p>Walkers may cross.</p></main>
    <aside data-label="side"><h3>Most read</h3><ul><li><a href="/1">Harbour reopens</a></li><li><a href="/2">Orchard prices</a></li></ul></aside>
    <section id="comments" data-label="comments"><h3>Comments</h3><p>I think that the bridge should have been closed years ago, it was never safe in the wind.</p><p>Me too.</p></section>{_FOOT}</body></html>""",
    # no semantic elements: a content div
    """<html><body><div id="menu" data-label="menu"><a href="/">Home</a> <a href="/b">Blog</a></div><div id="content" data-label="main"><h2>Notes on bread</h2><p>Flour, water, salt and time are all that a loaf needs, though most bakers add yeast.</p><p>Knead it well.</p><ul><li>Rest the dough for an hour.</li><li>Bake it hot.</li></ul></div>
    <div class="sidebar" data-label="side"><p>About the author: a baker who has written about bread for more than twenty years in this place.</p><a href="/c">Contact</a></div><div id="footer" data-label="footer">Powered by Example</div></body></html>""",
    # cookie notice, pop-up and login box around an article
    f"""<html><body><div class="cookie-notice" data-label="notice">We use cookies to make this site work and to learn how it is used. <a href="/k">Read more</a></div><div role="alert" data-label="notice">This site will be down on Sunday night for repairs.</div>
    <article data-label="main"><p>Rain is expected in the north from Tuesday, with wind along the coast and snow on the hills.</p><blockquote>It will be wet.</blockquote></article><div class="login-box" data-label="form"><p>Sign in to read more stories like this one every day of the week.</p></div>{_FOOT}</body></html>""",
    # plain page without any container: long paragraphs are text, link lists are not
    """<html><body><p data-label="menu"><a href="/">Home</a> | <a href="/x">Next</a> | <a href="/y">Up</a></p><p data-label="main">In those years the road to the lake was still a track of stones, and the carts that took the milk down to the town needed half a day for it.</p>
    <p data-label="main">My uncle drove one of them, and I was allowed to sit beside him when there was no school to go to and no hay to bring in.</p><p data-label="main">He sang all the way.</p><p data-label="menu"><a href="/z">Back to the list of stories</a></p></body></html>""",
    # related links after a post, tags, breadcrumbs
    f"""<html><body><div class="breadcrumbs" data-label="menu"><a href="/">Start</a> &gt; <a href="/g">Garden</a></div><div class="post" data-label="main"><h1>Pruning roses</h1><p>Cut above an outward bud, on a dry day, with a clean blade, and never in hard frost.</p><p>Burn what is sick.</p></div>
    <div class="related-posts" data-label="related"><h3>Read also</h3><p><a href="/l">Lilies in pots</a></p><p>Our guide to the best pots for lilies, with tests of twelve kinds.</p></div><p class="tags" data-label="tags"><a href="/t">roses</a>, <a href="/u">pruning</a></p>{_FOOT}</body></html>""",
    # article with its own header; banner, ad blocks of several lengths
    f"""<html><body><div class="banner" data-label="ad">Spring sale</div>{_NAV}<article data-label="main"><header><h1>Choir wins prize</h1></header><p>The choir of the lower village has won the prize of the county for the third time.</p><p>It sang two songs.</p><section><h2>What comes next</h2><p>In summer it travels to the coast.</p></section></article>
    <div class="advertisement" data-label="ad">Tired of slow trains? Take the new express, now with breakfast, from any station on the line and at half the price until June.</div><div class="ads" data-label="ad">Cheap boots.</div>{_FOOT}</body></html>""",
    # reader comments inside the article element
    f"""<html><body><article><div data-label="main"><h1>Trams return</h1><p>Trams will run again along the river from next year, the mayor said on Friday.</p><p>The first line has nine stops. <b>All are new.</b></p></div><div class="comment-list" data-label="comments"><p>Finally! I have waited for this since they tore up the rails.</p><p>Who pays?</p></div></article>{_FOOT}</body></html>""",
    # page with nothing but chrome
    f"""<html><body>{_NAV}<div class="popup" data-label="notice">Please allow notifications to hear about new offers first.</div><form data-label="form">Search the archive <input></form>{_FOOT}</body></html>""",
    # table and definition list in the text
    f"""<html><body>{_NAV}<article data-label="main"><h1>Tide table</h1><table><tr><td>High</td><td>06:10</td></tr><tr><td>Low</td><td>12:25</td></tr></table><dl><dt>Spring tide</dt><dd>The highest tide, near new and full moon.</dd></dl><p>See <a href="/moon">the moon</a>.</p></article>{_FOOT}</body></html>""",
    # main text without any telling element: short and long paragraphs, headings, a list, a table, a link in the text
    """<html><body><h1 data-label="main">The mill</h1><p data-label="main">It burnt down.</p><p data-label="main">Nobody was hurt, as the miller had taken his family to the fair in the next village that night.</p><p data-label="main">Why?</p></body></html>""",
    """<html><body><p data-label="main">Short paragraph.</p></body></html>""",
    """<html><body><p data-label="main">Tea.</p><p data-label="main">Coffee is grown in the hills, where the nights are cool, and carried down to the port by mules.</p></body></html>""",
    """<html><body><div data-label="main">A first note.</div><div data-label="main">A second one, somewhat longer than the first, about the weather on the pass in autumn.</div><ul data-label="main"><li>Bring a coat.</li><li>Bring bread.</li></ul></body></html>""",
    """<html><body><h2 data-label="main">Timetable</h2><table data-label="main"><tr><td>Monday</td><td>closed</td></tr><tr><td>Tuesday</td><td>nine to five</td></tr></table><p data-label="main">See the <a href="/n">notes</a> for holidays.</p></body></html>""",
    """<html><body><ul data-label="menu"><li><a href="/">Home</a></li><li><a href="/1">Lessons</a></li><li><a href="/2">Songs</a></li></ul><h1 data-label="main">Lesson one</h1><p data-label="main">Say good day.</p><p data-label="main">Then ask for the way to the station, as we have learnt it in the last lesson of the spring course.</p><ul data-label="menu"><li><a href="/l2">Lesson two</a></li><li><a href="/l3">Lesson three</a></li></ul></body></html>""",
    """<html><body><div data-label="menu"><a href="/a">Archive</a> <a href="/b">Books</a> <a href="/c">Contact us</a></div><p data-label="main">The book fair opens on Thursday. More than two hundred publishers have taken a stand, more than ever before.</p><p data-label="main">Entry is free.</p><div data-label="menu"><a href="/d">Older entries</a></div><div data-label="menu"><a href="/e">Newer entries</a></div></body></html>""",
    """<html><body><table><tr><td data-label="menu"><a href="/">Index</a></td><td data-label="menu"><a href="/u">Up one level</a></td></tr></table><p data-label="main">This page lists what is known of the old road, from the ford to the <a href="/inn">inn</a>.</p><p data-label="main">Little is left.</p></body></html>""",
    """<html><body><header data-label="header"><p>Notes from a small garden</p><p><a href="/">All notes</a></p></header><p data-label="main">The beans are up.</p><p data-label="main">It took them three weeks, which is long, but the soil was cold until the middle of May.</p><footer data-label="footer"><p>Written by hand since 1999.</p></footer></body></html>""",
    # menus, forms, footers and asides inside main and article
    """<html><body><main><nav data-label="menu">Home News Sport</nav><p data-label="main">The bakery on the square has a new owner, who means to keep the old oven.</p><p data-label="main">Bread stays cheap.</p></main></body></html>""",
    """<html><body><main><nav data-label="menu"><ul><li><a href="/1">Part one</a></li><li><a href="/2">Part two</a></li></ul></nav><article data-label="main"><h1>Part one</h1><p>We left at dawn.</p><p>The river was low, and the guide said that we might cross it on foot if nobody minded wet boots.</p><footer data-label="footer">Filed under travel by the desk.</footer></article></main></body></html>""",
    """<html><body><article><h1 data-label="main">Snow closes pass</h1><p data-label="main">The pass is closed.</p><aside data-label="side"><p>Five other passes that are closed in winter, and how to get around them by train or bus.</p></aside><p data-label="main">It may open at the weekend if the ploughs get through the drifts below the tunnel.</p><form data-label="form"><p>Get road news by mail every morning, free of charge and without advertising.</p></form></article></body></html>""",
    """<html><body><article class="story privacy-law" data-label="main"><h1>Court rules on letters</h1><p>Letters may not be opened.</p><p>The court said that the law on the privacy of letters holds for parcels too, if they are closed.</p></article></body></html>""",
    """<html><body><div class="story about-ads" data-label="main"><p>Who reads posters?</p><p>Hardly anyone, says a study of people who wait for the tram at six stops of the inner city.</p></div><div class="weekly-ad-box" data-label="ad"><p>Sofas, beds and tables at half the price this week in our shop by the station.</p></div></body></html>""",
    """<html><body><article class="post search-engine" data-label="main"><h2>How search works</h2><p>A list of words comes first.</p><p>For every word it holds the pages that have it, so that a question needs no reading of pages at all.</p></article><div class="search-box" data-label="form">Search this site for words</div></body></html>""",
    # comments by several names
    """<html><body><main><h1 data-label="main">New bins</h1><p data-label="main">The town will buy new bins.</p><p data-label="main">They are green, and taller than the old ones, which were easily turned over by the wind.</p><section class="reader-opinions" data-label="comments"><p>I like the old ones better, they were round and had a lid that one could open with a foot.</p><p>Green again!</p></section></main></body></html>""",
    """<html><body><article data-label="main"><p>The pool opens in June.</p><p>Until then the tiles are cleaned and the showers get new taps, which take less water than those of today.</p></article><div class="discussion" data-label="comments"><article class="comment"><p>At last.</p></article><article class="comment"><p>Will there be a slide this year, as there was when I was a child and came here every day?</p></article></div></body></html>""",
    """<html><body><div class="entry-content" data-label="main"><p>Pears keep until March.</p><p>Put them on straw so that they don't touch, in a room that is cool and dark, and look at them every week.</p></div><ol class="commentlist" data-label="comments"><li>Mine rot by Christmas, whatever I do, and I have tried straw, paper and sand.</li><li>Same here.</li></ol><div id="disqus_thread" data-label="comments"><p>Please log in to write what you think about this.</p></div></body></html>""",
    """<html><body><article><div class="article-body" data-label="main"><p>The band plays on Sunday.</p><p>It will be the last time with the old drummer, who moves to the coast to build boats.</p></div><div class="responses" data-label="comments"><h4>Three responses</h4><p>He was the best drummer that this town has ever had, and I have heard them all.</p></div></article></body></html>""",
    # a page in one form; content classes in chrome
    """<html><body><form id="aspnetForm"><div class="header" data-label="header">District library</div><main data-label="main"><h1>Opening hours</h1><p>We open at ten.</p><p>On Saturdays the reading room stays open until four, the lending desk until two.</p></main><div class="footer" data-label="footer"><div class="content">Market street 4, behind the town hall, second floor, ring twice.</div></div></form></body></html>""",
    """<html><body><aside data-label="side"><article><h3>Also in this issue</h3><p>A walk along the old canal, with a map and the times of all buses back to town.</p></article></aside><article data-label="main"><h1>Frost</h1><p>Cover the figs.</p><p>Two nights of frost are expected, and a third may follow if the sky stays clear until Friday.</p></article><div class="sidebar"><div class="text" data-label="side">Our pots are made of clay from the river and fired twice in a kiln that we built.</div></div></body></html>""",
    # a list of links inside an article, next to a list of text with a link; hidden text
    """<html><body><article><h1 data-label="main">Knots</h1><p data-label="main">Learn the bowline first.</p><ul data-label="main"><li>It holds a <a href="/r">rope</a> fast to a ring or post.</li><li>It opens easily.</li></ul><ul data-label="menu"><li><a href="/k1">Reef knot</a></li><li><a href="/k2">Clove hitch</a></li><li><a href="/k3">Sheet bend</a></li><li><a href="/k4">Figure of eight</a></li></ul></article></body></html>""",
    """<html><body><article><p data-label="main">A letter came.</p><p data-label="main">It had been on the way for nine years, <a href="/p">the post office</a> said, behind a cupboard.</p><p data-label="main"><a href="/more">The whole letter</a></p><p data-label="main">Nobody knows who wrote it.</p><div style="display: none" data-label="hidden">Text for machines that no reader ever sees on the page.</div></article></body></html>""",
    """<html><body><article><p data-label="main">Rice is soaked overnight.</p><p data-label="main"><a href="/s">Source: the cook book</a></p><p data-label="main">Drain it well before you steam it, or it will stick to the cloth and tear when you lift it out.</p></article><div class="recommended" data-label="related"><p>Noodles with sesame, a dish for hot days that needs no stove at all.</p></div></body></html>""",
    # linked headings, and paragraphs of one link at either end of an article
    """<html><body><nav data-label="menu"><a href="/">Home</a></nav><article data-label="main"><h1><a href="/storks">Storks are back</a></h1><p>Two pairs nest on the church.</p><p>They came on the first warm wind of March, eight days sooner than a year ago, as the sexton noted.</p><p><a href="/src">From the parish paper</a></p></article></body></html>""",
    """<html><body><div class="post" data-label="main"><h2><a href="/oil">Olive oil</a></h2><p>Press cold.</p><p>The first oil is green and sharp, and mellows in the jar until the new year.</p></div><div class="post" data-label="main"><h2><a href="/figs">Drying figs</a></h2><p>Split them, and turn them twice a day until they no longer stick to the board.</p><p><a href="/figs2">The second part</a></p></div></body></html>""",
    """<html><body><main data-label="main"><p><a href="/series">Our series on bridges</a></p><h1>The iron one</h1><p>It was cast in one winter.</p><p>A hundred men worked on it, most of them from the valley, and the smith had his forge on the bank.</p><p><a href="/photo">Picture: the town archive</a></p></main></body></html>""",
    """<html><body><article><h1 data-label="main"><a href="/tea">Tea on the train</a></h1><p data-label="main">It comes in a glass.</p><ul data-label="menu"><li><a href="/t1">Trains</a></li><li><a href="/t2">Stations</a></li><li><a href="/t3">Night trains to the south</a></li></ul><p data-label="main">The glass stands in a holder of brass, so that you can drink it while it is hot.</p></article></body></html>""",
    # names that hold a telling word among others
    """<html><body><div class="spring-promo-2024x" data-label="ad"><p>All chairs at half the price until the end of the month, in all our shops.</p></div><p data-label="main">The ferry runs again.</p><p data-label="main">It had been in the dock for three weeks, as its screw was bent by a log in the spring flood.</p><div id="zone-ads-qx" data-label="ad">Fresh fish at the pier.</div></body></html>""",
    """<html><body><div class="mega-sale-banner-qq" data-label="ad">Boots, coats and hats for the whole family at prices that you will not see again soon.</div><div class="entry" data-label="main"><p>Moss grows on the north side.</p><p>So they say, but in a damp wood it grows all around the trunk, as anyone can see.</p></div></body></html>""",
    # no telling element: a linked paragraph amid text is text, words amid links are a menu's
    """<html><body><p data-label="main">The survey is out, and it says that the shore has moved by two metres since the last one.</p><p data-label="main"><a href="/s">Read the survey of the shore</a></p><p data-label="main">Its makers have walked the whole coast, from the lighthouse to the border, with poles and a level.</p><p data-label="main"><a href="/m">A map of all the places</a></p><p data-label="main">Houses are safe for now, though the path along the cliff will have to be moved inland.</p></body></html>""",
    """<html><body><p data-label="main">Grind the corn on the day you need it, since meal turns bitter within a week or two.</p><p data-label="main"><a href="/mill">How to set the stones of a mill</a></p><p data-label="main">Sift it twice, and keep the bran for the hens, which lay better for it through the winter.</p></body></html>""",
    """<html><body><div data-label="menu"><a href="/1">Front page</a></div><div data-label="menu">Sections</div><div data-label="menu"><a href="/2">Town</a></div><div data-label="menu">and</div><div data-label="menu"><a href="/3">Country</a></div><p data-label="main">The council met on Tuesday to talk about the new road, and decided nothing, as the map was lost.</p><p data-label="main">It meets again in May.</p><div data-label="menu"><a href="/4">Mail</a></div><div data-label="menu">Follow us</div><div data-label="menu"><a href="/5">Radio</a></div></body></html>""",
    """<html><body><p data-label="menu"><a href="/x">Start</a></p><p data-label="menu">Languages</p><p data-label="menu"><a href="/de">Deutsch</a></p><p data-label="main">Welcome to the museum of clocks, which shows more than nine hundred of them, all going.</p><p data-label="menu"><a href="/t">Tickets</a></p><p data-label="menu">More here</p><p data-label="menu"><a href="/w">Workshop</a></p></body></html>""",
    # a linked item in a list of text
    """<html><body><article data-label="main"><p>You will need three things for the kite.</p><ul><li>Two thin sticks of spruce, the longer one as long as your arm.</li><li><a href="/paper">Strong paper</a></li><li>A ball of twine that does not stretch when it gets wet.</li></ul><p>Tie the sticks first.</p></article></body></html>""",
    """<html><body><main data-label="main"><h1>Three walks</h1><ol><li>Around the lake, two hours on good paths with many benches.</li><li><a href="/mill-walk">To the mill</a></li><li>Over the ridge to the next valley, a whole day, with a bus back.</li><li><a href="/night">By night</a></li><li>Along the railway, flat all the way and good for wheels.</li></ol></main></body></html>""",
    # short last and first words of an article, next to menus
    """<html><body><ul data-label="menu"><li><a href="/">Home</a></li><li><a href="/s">Sport</a></li></ul><article data-label="main"><h1>Final</h1><p>The river club won by a goal in the last minute of the second half, in pouring rain.</p><p>At last.</p></article><ul data-label="menu"><li><a href="/t">Table</a></li><li><a href="/f">Fixtures</a></li></ul></body></html>""",
    """<html><body><main data-label="main"><h2>Obituary</h2><p>The old ferryman has died at ninety. He had rowed the whole village over the lake, he used to say, and half of it twice.</p><p>Farewell.</p></main><div data-label="menu"><a href="/more">More notices of this week</a></div></body></html>""",
    """<html><body><div class="entry-content" data-label="main"><p>Rain again, so we stayed in and mended nets until it was too dark to see the knots.</p><p>Good night.</p></div><div data-label="menu"><a href="/prev">The day before</a></div><div data-label="menu"><a href="/next">The day after</a></div></body></html>""",
    """<html><body><article data-label="main"><p>Question one.</p><p><a href="/a1">See the answer</a></p><p>Question two.</p><p><a href="/a2">See the answer</a></p></article><p data-label="menu"><a href="/quiz">Other quizzes</a></p></body></html>""",
)
